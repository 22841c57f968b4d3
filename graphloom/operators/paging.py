"""Pages by cursor: rows behind the last key seen, instead of rows behind a number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(keys: list[Column], cursor: tuple) -> Column:
    """Whether the keys come after the cursor's values, key by key; nulls come first.

    Comparisons with literals, so that they reach the scan: the first key by itself as well, whose
    range skips files and row groups."""
    behind = None
    for key, value in reversed(list(zip(keys, cursor, strict=True))):
        later = key.isNotNull() if value is None else key > F.lit(value)
        behind = later if behind is None else later | (key.eqNullSafe(F.lit(value)) & behind)
    first = cursor[0]
    return behind if first is None else (keys[0] >= F.lit(first)) & behind


def page_after(rows: DataFrame, keys: list[str], cursor: tuple | None = None, limit: int = 100) -> DataFrame:
    """The next `limit` rows in the order of keys; cursor: the keys of the last row seen, None at the start.

    The keys must tell all rows apart.  Pages that follow each other give each row once."""
    behind = rows if cursor is None else rows.where(after([F.col(k) for k in keys], cursor))
    return behind.orderBy(*keys).limit(limit)


def cursor_of(row, keys: list[str]) -> tuple:
    """The cursor behind a row."""
    return tuple(row[k] for k in keys)
