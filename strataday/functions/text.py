"""String helpers whose NULL handling follows the study scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice_text(text: ColumnLike, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop``, both 1-based and inclusive."""
    return F.substring(_col(text).cast("string"), start, stop - start + 1)


def remove_text(text: ColumnLike, what: str) -> Column:
    return F.replace(_col(text).cast("string"), F.lit(what), F.lit(""))


def join_text(*parts: ColumnLike, sep: str = "") -> Column:
    """Join with a separator; NULL as soon as one part is NULL."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i and sep:
            pieces.append(F.lit(sep))
        pieces.append(_col(part).cast("string"))
    return F.concat(*pieces)


def paste(*parts: ColumnLike, sep: str = " ") -> Column:
    """Join with a separator; a NULL part is written as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_col(p).cast("string"), F.lit("NA")) for p in parts])
