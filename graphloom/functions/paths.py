"""Path arithmetic on columns, with forward slashes and no file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """Backslashes turned, repeated slashes and lone dots dropped."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), r"(?<=^|/)\./|/\.?$", "")


def normalized(path: Column) -> Column:
    """slashed(), then without any leading dots and slashes (so dot-folders lose their dot)."""
    return F.regexp_replace(slashed(path), r"^[./]+", "")


def parent(path: Column) -> Column:
    """The folder of a path; '.' for a bare name and for '.' itself."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def climb(folder: Column, steps: Column) -> Column:
    """The folder `steps` levels up; stays at '.' once there."""
    parts = F.filter(F.split(folder, "/"), lambda p: (p != "") & (p != "."))
    left = F.greatest(F.size(parts) - steps, F.lit(0))
    return F.when(left > 0, F.array_join(F.slice(parts, F.lit(1), left), "/")).otherwise(F.lit("."))


def join(folder: Column, name: Column) -> Column:
    return F.when(folder == ".", name).otherwise(F.concat(folder, F.lit("/"), name))


def collapsed(path: Column) -> Column:
    """Lexical removal of '.' and '..'; a '..' with nothing to remove stays."""

    def step(acc: Column, part: Column) -> Column:
        stuck = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & ~stuck, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step)
    return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))


def segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")))


def proper_suffixes(path: Column) -> Column:
    """Every tail of a path that begins after a slash."""
    parts = F.split(path, "/")
    n = F.size(parts)
    whole = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(n - i + 1, F.lit(0))), "/"))
    return F.filter(whole, lambda s: s != "")


def suffix(path: Column) -> Column:
    """Lower-cased file suffix with its dot; empty for none and for dot-files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))
