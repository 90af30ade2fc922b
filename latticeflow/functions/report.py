"""Logging, and text for people: money, time, counts, tables."""

from __future__ import annotations

import logging
import sys
from collections.abc import Sequence

ROOT = "latticeflow"


def setup(level: int = logging.INFO, stream=None) -> None:
    """One handler on the package's logger."""
    log = logging.getLogger(ROOT)
    log.handlers = [logging.StreamHandler(stream or sys.stderr)]
    log.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
    log.setLevel(level)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(name if name.startswith(ROOT) else f"{ROOT}.{name}")


def set_level(level: int) -> None:
    logging.getLogger(ROOT).setLevel(level)


def reset() -> None:
    log = logging.getLogger(ROOT)
    log.handlers, log.level = [], logging.NOTSET


def money(x: float) -> str:
    return f"{x:,.0f}" if x == int(x) else f"{x:,.2f}"


def duration(seconds: float) -> str:
    if seconds < 1:
        return f"{seconds * 1000:.0f} ms"
    if seconds < 60:
        return f"{seconds:.1f} s"
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes} min {rest} s"


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def table(head: Sequence[str], rows: Sequence[Sequence], least: int = 0) -> str:
    """Columns as wide as their widest cell."""
    cells = [list(map(str, head)), *[list(map(str, r)) for r in rows]]
    wide = [max(least, *(len(r[k]) for r in cells)) for k in range(len(head))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in wide), *lines[1:]])
