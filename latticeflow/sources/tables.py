"""Networks as folders of Parquet tables."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import SparkSession

from ..model import CHILDREN, GROUPS, LINKS, MEMBERS, NODES, Network

TABLES = {"nodes": NODES, "links": LINKS, "risk_groups": GROUPS, "children": CHILDREN, "members": MEMBERS}


def save(network: Network, path: str, mode: str = "error") -> None:
    """Writes each frame as a table, and the network's own attributes as one row of JSON."""
    for name in TABLES:
        getattr(network, name).write.mode(mode).parquet(f"{path}/{name}")
    spark = network.nodes.sparkSession
    spark.createDataFrame([(json.dumps(network.attrs),)], "attrs string").write.mode(mode).parquet(f"{path}/attrs")


def open_network(spark: SparkSession, path: str) -> Network:
    """Reads what save() wrote."""
    frames = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}
    row = spark.read.parquet(f"{path}/attrs").first()
    known = {f.name for f in fields(Network)}
    return Network(**{k: v for k, v in frames.items() if k in known}, attrs=json.loads(row.attrs) if row else {})
