import posixpath
import uuid
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ids, paths, shaping


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize("parts", [("r", "a.py"), ("r", None), ("", "ü✓", 7)])
def test_uuid5_is_the_standard_one(spark, parts):
    columns = [F.lit(p) if p is not None else F.lit(None).cast("string") for p in parts]
    got = spark.range(1).select(ids.uuid5(ids.PARSE_NAMESPACE, *columns)).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(ids.PARSE_NAMESPACE), "\x1f".join(map(str, parts))))


@pytest.mark.parametrize("path", ["a.py", "./a/b.py", "a//b.py", "a\\b.py", ".github/x.py", "/abs/x.py", "a/./b"])
def test_normalized(spark, path):
    assert one(spark, path, paths.normalized) == str(PurePosixPath(path.replace("\\", "/"))).lstrip("./")


@pytest.mark.parametrize("path", ["a/b/../c", "../x", "a/../../x", "./a", "a/./b", "."])
def test_collapsed(spark, path):
    assert one(spark, path, paths.collapsed) == posixpath.normpath(path)


@pytest.mark.parametrize("path", ["a.py", "x/.py", "x/a.tar.GZ", "x/a", "x.d/a", "a.", ".a.py"])
def test_suffix(spark, path):
    assert one(spark, path, paths.suffix) == PurePosixPath(path).suffix.lower().removesuffix("." if path.endswith(".") else "")


def test_climbing_stops_at_the_root(spark):
    for steps, want in ((0, "a/b"), (1, "a"), (2, "."), (9, ".")):
        assert one(spark, "a/b", lambda c, steps=steps: paths.climb(c, F.lit(steps))) == want


def test_proper_suffixes(spark):
    assert one(spark, "a/b/c.py", paths.proper_suffixes) == ["b/c.py", "c.py"]
    assert one(spark, "c.py", paths.proper_suffixes) == []


def test_shares_and_sizes(spark):
    row = spark.range(1).select(shaping.percent(F.lit(1), F.lit(16)).alias("tie"), shaping.percent(F.lit(1), F.lit(0)).alias("none"), shaping.size_label(F.lit(512)).alias("b"), shaping.size_label(F.lit(1536)).alias("k"), shaping.size_label(F.lit(5 << 30)).alias("g")).first()
    assert (row.tie, row.none, row.b, row.k, row.g) == (6.2, None, "512 B", "1.5 KB", "5 GB")


def test_sizes_at_the_half(spark, duck):
    """Halves of a byte go to the even number, and sixth decimals are rounded as SQL casts a double."""
    from graphloom.plans.driver_tables import SQL

    sizes = [0.5, 1.5, 74.5, 75.5, 1023.5] + [1024.0**p * (k + 0.05 * m) + d for p in (1, 2, 3) for k in (1, 17, 323) for m in (1, 3, 7, 19) for d in (-0.0005, -0.0001, 0.0, 0.0005)]
    sizes += [1024.0**p * (k + 0.0499995 + e * 1e-12) for p in (1, 2, 3) for k in range(1, 60) for e in (-1, 0, 1)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "k long, size double")
    label = SQL["size_labels"].split("SELECT o_orderkey, ")[2]
    duck.execute("create or replace temp table o as select unnest(?::bigint[]) as k, unnest(?::double[]) as size", [list(range(len(sizes))), sizes])
    want = dict(duck.sql(f"select k, {label}").fetchall())
    assert {r.k: r.label for r in rows.select("k", shaping.size_label(F.col("size")).alias("label")).collect()} == want


def test_property_bag_leaves_out_nulls(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(shaping.properties(["x", "y"])).first()[0] == {"x": "a"}


def test_iso_times(spark):
    from datetime import UTC, datetime

    for time in (datetime(2024, 1, 8, 3, 4, 5, tzinfo=UTC), datetime(2024, 7, 8, 3, 4, 5, 67, tzinfo=UTC)):
        df = spark.createDataFrame([(time,)], "t timestamp")
        assert df.select(shaping.iso_time(F.col("t"))).first()[0] == time.isoformat()
        assert df.select(shaping.properties(["t"], ("t",))).first()[0] == {"t": time.isoformat()}


def test_labels_and_depths(spark):
    row = spark.range(1).select(
        shaping.shares_label(F.create_map(F.lit("B"), F.lit(12.5), F.lit("A"), F.lit(87.5))).alias("two"),
        shaping.shares_label(F.expr("cast(map() as map<string,double>)")).alias("none"),
        *[shaping.depth_within(F.lit(v).cast("double"), 10).alias(f"d{i}") for i, v in enumerate((2.9, -3.0, 99.0, float("nan")))],
    ).first()
    assert tuple(row) == ("A 87.5%, B 12.5%", "No languages detected", 2, 1, 10, 1)
