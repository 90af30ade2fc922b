"""Names and templates: brackets, variables, paths, seeds and number keys."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_COMBINATIONS = 10_000


def expand_brackets(text: str) -> list[str]:
    """'a[1-2]_[x,y]' in all combinations, the first bracket slowest."""
    parts = re.split(r"\[([^\]]*)\]", text)
    choices = [[p] if k % 2 == 0 else _bracket(p) for k, p in enumerate(parts)]
    return ["".join(c) for c in itertools.product(*choices)]


def _bracket(body: str) -> list[str]:
    out: list[str] = []
    for part in body.split(","):
        lo, dash, hi = part.strip().partition("-")
        if not dash:
            out.append(part.strip())
            continue
        if not (lo.isdigit() and hi.isdigit()) or int(lo) > int(hi):
            raise ValueError(f"bad range {part!r}")
        out += [str(n) for n in range(int(lo), int(hi) + 1)]
    return out


def expand_refs(names: Sequence[str]) -> list[str]:
    return sorted({x for n in names for x in expand_brackets(n)})


def substitute(value, variables: Mapping):
    """$name and ${name} in nested strings; an unknown name raises KeyError."""
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            name = m[1] or m[2]
            if name not in variables:
                raise KeyError(name)
            return str(variables[name])

        return re.sub(r"\$\{(\w+)\}|\$([A-Za-z_]\w*)", one, value)
    if isinstance(value, Mapping):
        return {k: substitute(v, variables) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [substitute(v, variables) for v in value]
    return value


def combinations(variables: Mapping[str, Sequence], mode: str = "cartesian") -> list[dict]:
    """One dict for each combination, variables in the order of their names."""
    names = sorted(variables)
    if mode == "zip":
        if len({len(variables[n]) for n in names}) > 1:
            raise ValueError("zip needs lists of one length")
        rows = list(zip(*(variables[n] for n in names), strict=True))
    elif mode == "cartesian":
        size = 1
        for n in names:
            size *= len(variables[n])
        if size > MOST_COMBINATIONS:
            raise ValueError(f"{size} combinations, at most {MOST_COMBINATIONS}")
        rows = list(itertools.product(*(variables[n] for n in names)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if len(rows) > MOST_COMBINATIONS:
        raise ValueError(f"{len(rows)} combinations, at most {MOST_COMBINATIONS}")
    return [dict(zip(names, r, strict=True)) for r in rows]


def expand_block(block: Mapping) -> list[dict]:
    """A block with 'expand' becomes one block for each combination of its variables."""
    spec = block.get("expand")
    rest = {k: v for k, v in block.items() if k != "expand"}
    if not spec or not spec.get("vars"):
        return [rest]
    return [substitute(rest, c) for c in combinations(spec["vars"], spec.get("mode", "cartesian"))]


def join_path(parent: str, name: str) -> str:
    name = name.removeprefix("/")
    return f"{parent}/{name}" if parent else name


def derive_seed(master: int | None, *parts) -> int | None:
    """A 31-bit seed from the first bytes of a SHA-256; none without a master seed."""
    if master is None:
        return None
    text = ":".join(map(str, (master, *parts)))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big") & 0x7FFFFFFF


def failure_id(nodes: Sequence[str], links: Sequence[str]) -> str:
    """Eight bytes of blake2s in hex; empty for no failure."""
    if not nodes and not links:
        return ""
    return hashlib.blake2s(f"{','.join(sorted(nodes))}|{','.join(sorted(links))}".encode(), digest_size=8).hexdigest()


def number_key(x: float) -> str:
    """Fixed-point text without trailing zeros."""
    text = f"{x:.9f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def number_key_column(x: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.9f", x), "0+$", ""), r"\.$", "")
    return F.when(text.isin("-0", ""), F.lit("0")).otherwise(text)
