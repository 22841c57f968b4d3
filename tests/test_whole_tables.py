"""Queries that take whole tables, with nothing filtered away."""

from graphloom.plans.driver_tables import QUERIES

from .conftest import DATA


def test_all_calls_are_edges(spark, duck):
    want = duck.sql("SELECT count(*) FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1").fetchall()[0][0]
    assert {r.kind: r.n for r in QUERIES["stats_rels_by_kind"](spark, str(DATA)).collect()}["calls"] == want


def test_all_successions_are_imports(spark, duck):
    pairs = duck.sql("SELECT DISTINCT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1").fetchall()
    parts = duck.sql("SELECT count(*) FROM part").fetchall()[0][0]
    assert QUERIES["suffix_match"](spark, str(DATA)).count() == len(pairs)
    assert QUERIES["ecmascript_imports"](spark, str(DATA)).count() == len(pairs) + parts


def test_every_document_is_sniffed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: b"Th" in (r.text or "").encode()[:8192] for r in docs}
    assert {r.doc_id: r.sniffed for r in QUERIES["sniff_prefix"](spark, str(DATA)).collect()} == want


def test_degrees_store_rows_of_nodes_not_of_edges(spark, monkeypatch):
    from graphloom.plans import driver_tables

    kept, stored = [], driver_tables.stored
    monkeypatch.setattr(driver_tables, "stored", lambda rows, *more: kept.append(stored(rows, *more)) or kept[-1])
    t = driver_tables.Tables(spark, str(DATA))
    nodes, calls = t.nodes.count(), t.calls.count()
    assert QUERIES["summaries_after_replace"](spark, str(DATA)).count() == nodes
    assert 0 < sum(rows.count() for rows in kept) <= 2 * nodes < calls


def test_equal_imports_are_counted(spark):
    from graphloom.plans.driver_tables import Tables

    t = Tables(spark, str(DATA))
    whole = {(r.source_id, r.target_id, r.repository_id): r["count"] for r in t.imports.groupBy("source_id", "target_id", "repository_id").count().collect()}
    counted = t.counted_imports.collect()
    assert {(r.source_id, r.target_id, r.repository_id): r.n for r in counted} == whole and len(counted) == len(whole)


def test_lines_are_not_shuffled_by_customer(spark):
    from graphloom.plans.driver_tables import Tables

    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # customers beyond the bound
    try:
        plan = Tables(spark, str(DATA)).imports._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha())
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(c_custkey" in line]
    assert len(shuffles) == 2
    for i in shuffles:
        below = []
        for line in plan[i + 1 :]:
            if depth(line) <= depth(plan[i]):
                break
            below.append(line)
        assert below and not any("l_suppkey" in line for line in below)
