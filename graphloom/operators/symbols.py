"""Call and inheritance resolution: which symbol a name in the source means.

A reference is (ref, file_id, name, ...).  Each distinct (file, text) is resolved once
and joined back, so a name called a thousand times costs one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shaping import quoted
from .skew import dealt_join, maybe_present


class Scope:
    """What the files of a repository define at top level and bind by imports."""

    def __init__(self, symbols: DataFrame, imports: DataFrame):
        """imports: as resolve_imports() returns them."""
        top = symbols.where("parent_symbol_id is null").groupBy("file_id", "name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("symbol_id"))
        self.top = top
        #: a name defined twice in a file counts as not defined there when seen from elsewhere
        self.unique = top.where("n = 1").select(F.col("file_id").alias("target_file_id"), "name", "kind", "symbol_id")
        self.methods = symbols.where("kind = 'method'").groupBy("file_id", "parent_symbol_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("symbol_id"))
        bound = imports.select("file_id", "alias", "imported_names", F.when(F.col("resolution_status") == "resolved", F.col("target_file_id")).alias("target_file_id"))
        names = F.array_compact(F.array_union(F.array("alias"), F.coalesce("imported_names", F.expr("cast(array() as array<string>)"))))
        self.bindings = bound.select("file_id", "target_file_id", F.explode(names).alias("bound")).distinct()
        self.wildcards = bound.where(F.array_contains("imported_names", "*") & F.col("target_file_id").isNotNull()).select("file_id", "target_file_id").distinct()


def outcome(status: str | Column, file_id: Column | None = None, symbol_id: Column | None = None, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        (none if file_id is None else file_id).alias("target_file_id"),
        (none if symbol_id is None else symbol_id).alias("target_symbol_id"),
        (none if detail is None else detail).alias("detail"),
    )


def candidates(scope: Scope, refs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """refs with, for each kind: n_own and own (the file's top level), n_from and from (distinct imported definitions).

    All kinds are looked up in the same joins.  Of names asked through wildcards only those that some
    wildcard's file may define are joined, by a bitmap; a name that very many files ask of one file is
    dealt out."""
    some = F.col("kind").isin(*kinds)
    of = {k: F.col("kind") == k for k in kinds}
    own = scope.top.where(some).groupBy("file_id", "name").agg(*[c for k in kinds for c in (F.max(F.when(of[k], F.col("n"))).alias(f"n_own_{k}"), F.max(F.when(of[k], F.col("symbol_id"))).alias(f"own_{k}"))])
    unique = scope.unique.where(some)
    bound = scope.bindings.where("target_file_id is not null").withColumnRenamed("bound", "name")
    columns = ["file_id", "name", "kind", "symbol_id", "target_file_id"]
    explicit = refs.join(bound, ["file_id", "name"]).join(unique, ["target_file_id", "name"]).select(columns)
    offered = unique.join(scope.wildcards.select("target_file_id").distinct(), "target_file_id", "left_semi")
    asked = maybe_present(refs.select("file_id", "name"), ["name"], offered).join(scope.wildcards, "file_id")
    asked = maybe_present(asked, ["target_file_id", "name"], offered)
    wild = dealt_join(asked, offered, ["target_file_id", "name"], "file_id").select(columns)
    first = F.struct("symbol_id", "target_file_id")
    brought = explicit.unionByName(wild).distinct().groupBy("file_id", "name").agg(*[c for k in kinds for c in (F.count_if(of[k]).alias(f"n_from_{k}"), F.min(F.when(of[k], first)).alias(f"from_{k}"))])
    return refs.join(own, ["file_id", "name"], "left").join(brought, ["file_id", "name"], "left")


def choice(kind: str) -> Column:
    """First the file's own top level; only if that has nothing, imported definitions, by name or by wildcard."""
    name, own, n = quoted(F.col("name")), F.coalesce(f"n_own_{kind}", F.lit(0)), F.coalesce(f"n_from_{kind}", F.lit(0))
    return (
        F.when(own == 1, outcome("resolved", F.col("file_id"), F.col(f"own_{kind}")))
        .when(own > 1, outcome("ambiguous", F.col("file_id"), None, F.concat(F.lit("this file defines "), name, F.lit(" more than once"))))
        .when(n == 1, outcome("resolved", F.col(f"from_{kind}.target_file_id"), F.col(f"from_{kind}.symbol_id")))
        .when(n > 1, outcome("ambiguous", None, None, F.concat(F.lit("imports bring "), n.cast("string"), F.lit(" definitions of "), name)))
        .otherwise(outcome("unresolved", None, None, F.concat(F.lit("nothing in reach is called "), name)))
    )


def bare_names(scope: Scope, refs: DataFrame, kind: str) -> DataFrame:
    """refs: distinct (file_id, name).  Adds `result`."""
    return candidates(scope, refs, (kind,)).select("file_id", "name", choice(kind).alias("result"))


def qualified_names(scope: Scope, refs: DataFrame, kind: str) -> DataFrame:
    """refs: distinct (file_id, name) with a dot in name.  Adds `result`.

    Only one dot with text on both sides can be looked up: the part before it must be
    bound by an import of the file, the part after it defined once in the imported file."""
    dots = F.length("name") - F.length(F.translate("name", ".", ""))
    split = refs.withColumn("dots", dots).withColumn("qualifier", F.substring_index("name", ".", 1)).withColumn("member", F.substring_index("name", ".", -1))
    usable = split.where("dots = 1 and qualifier <> '' and member <> ''")
    bindings = scope.bindings.withColumnRenamed("bound", "qualifier")
    unique = scope.unique.where(F.col("kind") == kind).select("target_file_id", F.col("name").alias("member"), "symbol_id")
    seen = usable.join(bindings, ["file_id", "qualifier"]).join(unique, ["target_file_id", "member"], "left")
    found = seen.groupBy("file_id", "name").agg(F.count_distinct("symbol_id").alias("n"), F.min(F.when(F.col("symbol_id").isNotNull(), F.struct("symbol_id", "target_file_id"))).alias("first"))
    q, m = quoted(F.col("qualifier")), quoted(F.col("member"))
    result = (
        F.when(F.col("dots") != 1, outcome("unresolved", None, None, F.lit("more than one dot: the owner's type is unknown")))
        .when((F.col("qualifier") == "") | (F.col("member") == ""), outcome("unresolved", None, None, F.lit("one side of the dot is empty")))
        .when(F.col("n") == 1, outcome("resolved", F.col("first.target_file_id"), F.col("first.symbol_id")))
        .when(F.col("n") > 1, outcome("ambiguous", None, None, F.concat(F.lit("several files known as "), q, F.lit(" have "), m)))
        .when(F.col("n") == 0, outcome("unresolved", None, None, F.concat(F.lit("the file known as "), q, F.lit(" lacks "), m)))
        .otherwise(outcome("unresolved", None, None, F.concat(F.lit("no import is known as "), q)))
    )
    return split.join(found, ["file_id", "name"], "left").select("file_id", "name", result.alias("result"))


def instance_names(scope: Scope, refs: DataFrame) -> DataFrame:
    """refs: distinct (file_id, parent_symbol_id, name) of self./this. calls.  Adds `result`.

    Only methods with the caller's own parent count; base classes are not searched."""
    name = F.substring("name", 6, 1 << 20)
    asked = refs.withColumn("method", name)
    own = scope.methods.select("file_id", "parent_symbol_id", F.col("name").alias("method"), "n", "symbol_id")
    m = quoted(F.col("method"))
    result = (
        F.when(F.col("parent_symbol_id").isNull(), outcome("unresolved", None, None, F.lit("the caller belongs to no class")))
        .when(F.col("n") == 1, outcome("resolved", F.col("file_id"), F.col("symbol_id")))
        .when(F.col("n") > 1, outcome("ambiguous", F.col("file_id"), None, F.concat(F.lit("the class has several "), m)))
        .otherwise(outcome("unresolved", None, None, F.concat(F.lit("the class itself has no "), m)))
    )
    return asked.join(own, ["file_id", "parent_symbol_id", "method"], "left").select("file_id", "parent_symbol_id", "name", result.alias("result"))


def call_names(scope: Scope, refs: DataFrame) -> DataFrame:
    """refs: distinct (file_id, name) of bare calls: a function, else a class, else ambiguity, else nothing."""
    both = candidates(scope, refs, ("function", "class")).select("file_id", "name", choice("function").alias("f"), choice("class").alias("c"))
    either = (F.col("f.status") == "ambiguous") | (F.col("c.status") == "ambiguous")
    result = (
        F.when(F.col("f.status") == "resolved", F.col("f"))
        .when(F.col("c.status") == "resolved", F.col("c"))
        .when(either, outcome("ambiguous", None, None, F.concat(quoted(F.col("name")), F.lit(" could be one of several definitions"))))
        .otherwise(F.col("f"))
    )
    return both.select("file_id", "name", result.alias("result"))


def resolve_calls(scope: Scope, calls: DataFrame) -> DataFrame:
    """calls: rows with file_id, parent_symbol_id (of the caller) and name.  Adds `result`."""
    instance = F.startswith("name", F.lit("self.")) | F.startswith("name", F.lit("this."))
    dotted = F.contains(F.col("name"), F.lit("."))
    own = calls.where(instance)
    by_class = instance_names(scope, own.select("file_id", "parent_symbol_id", "name").distinct())
    by_class = by_class.select(F.col("file_id").alias("its_file"), F.col("parent_symbol_id").alias("its_parent"), F.col("name").alias("its_name"), "result")
    same = (F.col("file_id") == F.col("its_file")) & F.col("parent_symbol_id").eqNullSafe(F.col("its_parent")) & (F.col("name") == F.col("its_name"))
    out = own.join(by_class, same).select(*calls.columns, "result")
    for mask, resolver in ((~instance & dotted, lambda r: qualified_names(scope, r, "function")), (~instance & ~dotted, lambda r: call_names(scope, r))):
        rows = calls.where(mask)
        out = out.unionByName(rows.join(resolver(rows.select("file_id", "name").distinct()), ["file_id", "name"]).select(*calls.columns, "result"))
    return out


def resolve_bases(scope: Scope, bases: DataFrame) -> DataFrame:
    """bases: rows with file_id and name.  Adds `result`."""
    dotted = F.contains(F.col("name"), F.lit("."))
    out = None
    for mask, resolver in ((dotted, qualified_names), (~dotted, bare_names)):
        rows = bases.where(mask)
        part = rows.join(resolver(scope, rows.select("file_id", "name").distinct(), "class"), ["file_id", "name"]).select(*bases.columns, "result")
        out = part if out is None else out.unionByName(part)
    return out
