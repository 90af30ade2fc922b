"""Token counts by an exact histogram of encoded lengths.

Every document is encoded once; each task folds its documents into (length, documents) pairs, so
what is shuffled is bounded by the distinct lengths and not by the documents.  Suffix sums over the
histogram then answer totals, quantiles and truncated totals for every context limit at once.

Defined results: null and empty texts have length 0; repeated rows count as often as they occur; an
empty table gives an empty histogram; columns other than the text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024


def encoder(path: str = VOCABULARY, pattern: str | None = None):
    """A byte-level BPE from a file of ranks; pattern splits the text beforehand."""
    import base64

    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): how many documents have each encoded length."""

    def fold(batches):
        import pyarrow as pa

        bpe, found = encoder(vocabulary), Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found[len(bpe.encode_ordinary(x)) if x else 0] += 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(found), pa.int64()), "n_docs": pa.array(list(found.values()), pa.int64())})

    each = docs.select(F.col(text).alias("text")).mapInArrow(fold, "length long, n_docs long")
    return cut(each.groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "lengths")  # read more than once, encoded once


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L taken as a context limit: what lies at, above and below it.

    The sums run in two levels, over blocks of lengths and within each block, so that no task sees
    the whole histogram.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("n_tokens").alias("b_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("over_docs"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("over_tokens"),
        F.sum("b_docs").over(every).alias("total_docs"),
        F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    r = h.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("over_docs") + F.sum("n_docs").over(within)).alias("docs_ge"),
        (F.col("over_tokens") + F.sum("n_tokens").over(within)).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    docs_gt, tokens_gt = F.col("docs_ge") - F.col("n_docs"), F.col("tokens_ge") - F.col("length") * F.col("n_docs")
    return r.select(
        "length",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("total_tokens") - tokens_gt + F.col("length") * docs_gt).alias("truncated_total"),
        ((F.col("total_docs") - docs_gt) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, kept_tokens, cut_docs) for any limits, present as lengths or not."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    docs_gt, tokens_gt = F.col("docs_ge") - F.col("n_docs"), F.col("tokens_ge") - F.col("length") * F.col("n_docs")
    below = F.col("length") <= F.col("context_limit")
    met = sums.join(F.broadcast(asked), below, "right").groupBy("context_limit").agg(
        F.max_by(F.struct(docs_gt.alias("d"), tokens_gt.alias("t")), F.col("length")).alias("at")
    )
    total = sums.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"))
    n, t = F.coalesce(F.col("total_docs"), F.lit(0)), F.coalesce(F.col("total_tokens"), F.lit(0))
    cut = F.coalesce(F.col("at.d"), n)
    return met.join(F.broadcast(total)).select(
        "context_limit", (t - F.coalesce(F.col("at.t"), t) + F.col("context_limit") * cut).alias("kept_tokens"), cut.alias("cut_docs")
    )


def length_quantiles(sums: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(probability, length): the smallest length that so many of the documents do not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(p),) for p in probabilities], "probability double")
    met = sums.join(F.broadcast(asked), F.col("quantile") >= F.col("probability"), "right")
    return met.groupBy("probability").agg(F.min("length").alias("length"))
