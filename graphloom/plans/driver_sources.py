"""Source files built from the part table, discovered, parsed and assembled; each query with its SQL.

Part k is a Python (k % 3 = 0), TypeScript (1) or JavaScript (2) file with one class of one
method and a function.  Every tenth size adds a broken line; some files cannot be read, are
too long, binary, or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import listings
from ..schemas import DEPENDENCY_EDGES
from ..scratch import stored
from ..sources import files, parsing
from . import responses
from .driver_tables import Tables, query
from .project import fitted, graph_edges, graph_nodes

PYTHON = """import {n} as t
from .{b} import a, z as c

class C{k}(Base{s}):
    def m{s}(self, x: int = {s}, *rest):
        self.n{s}(x)
        return outer(inner({k}))

def f{k}(a, b="{b}"):
    def g{k}():
        pass
    return t.go(a)
{x}"""
PYTHON_BROKEN = "x = = (\ndef late{k}(): pass\n"
TYPESCRIPT = """import d, { a, z as c } from './{n}';
export class C{k}<T> extends Base{s} implements I {
  m{s}(x: number, y?: string): void { this.n{s}(x); outer(inner({k})); }
}
export function f{k}(a: string = "{b}") { return d.go(a); }
{x}"""
JAVASCRIPT = """import * as d from "./{n}";
class C{k} extends Base{s} {
  m{s}(x, y = {s}) { this.n{s}(x); outer(inner({k})); }
}
function f{k}(a, ...rest) { return <p on={d.go(a)}>it's</p>; }
{x}"""
BRACES_BROKEN = "function ( {\n"
LONGEST = 1 << 20


def filled(template: str, broken: str) -> Column:
    """A template with the part's number, size, type and brand put in."""
    text = F.replace(F.lit(template), F.lit("{x}"), F.when(F.pmod("p_size", F.lit(10)) == 0, broken).otherwise(""))
    values = {"{k}": F.col("p_partkey").cast("string"), "{s}": F.col("p_size").cast("string"), "{n}": F.lower("p_type"), "{b}": F.lower(F.translate("p_brand", "#", "_"))}
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def found(t: Tables) -> DataFrame:
    """Every part's file as discovery reports it."""
    k = F.col("p_partkey")

    def every(n: int) -> Column:
        return F.pmod(k, F.lit(n)) == 0

    language = F.pmod(k, F.lit(3))
    ending = F.when(language == 0, ".py").when(language == 1, F.when(every(2), ".tsx").otherwise(".ts")).otherwise(F.when(every(2), ".jsx").otherwise(".js"))
    text = F.when(language == 0, filled(PYTHON, PYTHON_BROKEN)).when(language == 1, filled(TYPESCRIPT, BRACES_BROKEN)).otherwise(filled(JAVASCRIPT, BRACES_BROKEN))
    content = F.when(every(29), F.lit("")).when(every(17), F.concat(F.lit("\x00"), text)).otherwise(text).cast("binary")
    rows = files.dealt(t.part.select("p_partkey", "p_size", "p_type", "p_brand"), "p_partkey").select(
        F.concat(F.lit("src/p"), k.cast("string"), ending).alias("relative_path"), F.when(every(23), F.lit("size unknown: no")).alias("error"),
        F.when(~every(23), F.when(every(19), F.lit(LONGEST + 1)).otherwise(F.octet_length(content)).cast("long")).alias("length"),
        F.when(~(every(23) | every(19)), content).alias("content"),
    )
    return files.classified(rows, LONGEST)


def tables(t: Tables) -> dict[str, DataFrame]:
    """The six tables of one parse of all files."""
    seen = stored(found(t), "found")
    return parsing.relational("R0", stored(parsing.parsed(seen), "parsed"))


# the same files in SQL: p has the readable ones, whole has those with text
SOURCES = """p AS (SELECT p_partkey AS k, p_size AS s, lower(p_type) AS n, lower(replace(p_brand, '#', '_')) AS b, p_partkey % 3 AS l, p_size % 10 = 0 AS broken,
    'src/p' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN CASE p_partkey % 2 WHEN 0 THEN '.tsx' ELSE '.ts' END ELSE CASE p_partkey % 2 WHEN 0 THEN '.jsx' ELSE '.js' END END AS path FROM part),
  good AS (SELECT * FROM p WHERE k % 23 <> 0 AND k % 19 <> 0 AND (k % 17 <> 0 OR k % 29 = 0)),
  whole AS (SELECT * FROM good WHERE k % 29 <> 0),
  s AS (SELECT path, 'class' AS kind, 'C' || k AS name, 'C' || k AS qualified_name, CASE l WHEN 0 THEN 4 ELSE 2 END AS start_line, CASE l WHEN 0 THEN 7 ELSE 4 END AS end_line, CASE l WHEN 1 THEN 7 ELSE 0 END AS start_column, l, k, s, b, n, 'Base' || s AS bases FROM whole
    UNION ALL SELECT path, 'method', 'm' || s, 'C' || k || '.m' || s, CASE l WHEN 0 THEN 5 ELSE 3 END, CASE l WHEN 0 THEN 7 ELSE 3 END, CASE l WHEN 0 THEN 4 ELSE 2 END, l, k, s, b, n, NULL FROM whole
    UNION ALL SELECT path, 'function', 'f' || k, 'f' || k, CASE l WHEN 0 THEN 9 ELSE 5 END, CASE l WHEN 0 THEN 12 ELSE 5 END, CASE l WHEN 1 THEN 7 ELSE 0 END, l, k, s, b, n, NULL FROM whole
    UNION ALL SELECT path, 'function', 'g' || k, 'f' || k || '.g' || k, 10, 11, 4, l, k, s, b, n, NULL FROM whole WHERE l = 0
    UNION ALL SELECT path, 'function', 'late' || k, 'late' || k, 14, 14, 0, l, k, s, b, n, NULL FROM whole WHERE l = 0 AND broken),
  a AS (SELECT path, qualified_name, unnest(CASE
      WHEN kind = 'method' AND l = 0 THEN [{'position': 0, 'name': 'self', 'annotation': NULL, 'default_value': NULL}, {'position': 1, 'name': 'x', 'annotation': 'int', 'default_value': '' || s}, {'position': 2, 'name': 'rest', 'annotation': NULL, 'default_value': NULL}]
      WHEN kind = 'method' AND l = 1 THEN [{'position': 0, 'name': 'x', 'annotation': 'number', 'default_value': NULL}, {'position': 1, 'name': 'y', 'annotation': 'string', 'default_value': NULL}]
      WHEN kind = 'method' THEN [{'position': 0, 'name': 'x', 'annotation': NULL, 'default_value': NULL}, {'position': 1, 'name': 'y', 'annotation': NULL, 'default_value': '' || s}]
      WHEN starts_with(name, 'f') AND l = 0 THEN [{'position': 0, 'name': 'a', 'annotation': NULL, 'default_value': NULL}, {'position': 1, 'name': 'b', 'annotation': NULL, 'default_value': '"' || b || '"'}]
      WHEN starts_with(name, 'f') AND l = 1 THEN [{'position': 0, 'name': 'a', 'annotation': 'string', 'default_value': '"' || b || '"'}]
      WHEN starts_with(name, 'f') THEN [{'position': 0, 'name': 'a', 'annotation': NULL, 'default_value': NULL}, {'position': 1, 'name': 'rest', 'annotation': NULL, 'default_value': NULL}] END, recursive := true) FROM s),
  c AS (SELECT path, qualified_name, unnest(CASE
      WHEN kind = 'method' THEN [{'ordinal': 0, 'callee': CASE l WHEN 0 THEN 'self.n' ELSE 'this.n' END || s, 'line': CASE l WHEN 0 THEN 6 ELSE 3 END}, {'ordinal': 1, 'callee': 'outer', 'line': CASE l WHEN 0 THEN 7 ELSE 3 END}, {'ordinal': 2, 'callee': 'inner', 'line': CASE l WHEN 0 THEN 7 ELSE 3 END}]
      WHEN starts_with(name, 'f') THEN [{'ordinal': 0, 'callee': CASE l WHEN 0 THEN 't.go' ELSE 'd.go' END, 'line': CASE l WHEN 0 THEN 12 ELSE 5 END}] END, recursive := true) FROM s),
  i AS (SELECT path, CASE l WHEN 0 THEN n ELSE './' || n END AS module, CASE l WHEN 1 THEN 'a,z' ELSE '' END AS names, CASE l WHEN 0 THEN 't' ELSE 'd' END AS alias, 1 AS line FROM whole
    UNION ALL SELECT path, '.' || b, 'a,z', NULL, 2 FROM whole WHERE l = 0)"""


@query(f"""WITH {SOURCES} SELECT path, CASE WHEN k % 23 = 0 THEN 'read' END AS stage,
  CASE WHEN k % 23 = 0 THEN 'size unknown: no' WHEN k % 19 = 0 THEN '{LONGEST + 1} bytes; up to {LONGEST} are parsed' WHEN k % 17 = 0 AND k % 29 <> 0 THEN 'a NUL byte near the start: no text' END AS reason FROM p""")
def discovery(spark, sf_dir):
    """Every file with the reason for which it is passed over, if any."""
    return found(Tables(spark, sf_dir)).select(F.col("relative_path").alias("path"), "stage", "reason")


@query(f"WITH {SOURCES} SELECT path, CASE l WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'javascript' END AS language, k % 29 <> 0 AND broken AS has_syntax_errors FROM good")
def parse_files(spark, sf_dir):
    return tables(Tables(spark, sf_dir))["parsed_files"].select("path", "language", "has_syntax_errors")


@query(f"WITH {SOURCES} SELECT path AS file_path, 'read' AS stage, 'size unknown: no' AS message FROM p WHERE k % 23 = 0")
def parse_failures(spark, sf_dir):
    """Only files that could not be read leave a row; those passed over do not."""
    return listings.parse_errors(tables(Tables(spark, sf_dir))["parse_errors"], "R0")


def named(parse: dict[str, DataFrame]) -> DataFrame:
    """symbol_id, path, qualified_name."""
    paths = parse["parsed_files"].select(F.col("id").alias("file_id"), "path")
    return parse["symbols"].select(F.col("id").alias("symbol_id"), "file_id", "qualified_name").join(paths, "file_id").drop("file_id")


@query(f"WITH {SOURCES} SELECT path, kind, name, qualified_name, start_line, end_line, start_column, bases FROM s")
def parse_symbols(spark, sf_dir):
    parse = tables(Tables(spark, sf_dir))
    rows = parse["symbols"].withColumnRenamed("id", "symbol_id").drop("qualified_name").join(named(parse), "symbol_id")
    return rows.select("path", "kind", "name", "qualified_name", "start_line", "end_line", "start_column", F.array_join("base_class_names", ",").alias("bases"))


@query(f"WITH {SOURCES} SELECT path, s.qualified_name, CASE WHEN contains(s.qualified_name, '.') THEN split_part(s.qualified_name, '.', 1) END AS parent FROM s")
def parse_parents(spark, sf_dir):
    """Symbols with the one that encloses them."""
    parse = tables(Tables(spark, sf_dir))
    of = parse["symbols"].select(F.col("id").alias("symbol_id"), "parent_symbol_id")
    above = named(parse).select(F.col("symbol_id").alias("parent_symbol_id"), F.col("qualified_name").alias("parent"))
    return named(parse).join(of, "symbol_id").join(above, "parent_symbol_id", "left").select("path", "qualified_name", "parent")


@query(f"WITH {SOURCES} SELECT path, qualified_name, position, name, annotation, default_value FROM a")
def parse_parameters(spark, sf_dir):
    parse = tables(Tables(spark, sf_dir))
    return parse["parameters"].join(named(parse), "symbol_id").select("path", "qualified_name", "position", "name", "annotation", "default_value")


@query(f"WITH {SOURCES} SELECT path, qualified_name, ordinal, callee, line FROM c")
def parse_calls(spark, sf_dir):
    parse = tables(Tables(spark, sf_dir))
    return parse["call_sites"].join(named(parse), "symbol_id").select("path", "qualified_name", "ordinal", F.col("callee_expression").alias("callee"), F.col("start_line").alias("line"))


@query(f"WITH {SOURCES} SELECT path, module, names, alias, line FROM i")
def parse_imports(spark, sf_dir):
    parse = tables(Tables(spark, sf_dir))
    paths = parse["parsed_files"].select(F.col("id").alias("file_id"), "path")
    return parse["imports"].join(paths, "file_id").select("path", "module", F.array_join("imported_names", ",").alias("names"), "alias", F.col("start_line").alias("line"))


@query(f"""WITH {SOURCES}, sl AS (SELECT path, string_agg(qualified_name, ',' ORDER BY start_line) AS symbols FROM s GROUP BY 1), il AS (SELECT path, string_agg(module, ',' ORDER BY module) AS imports FROM i GROUP BY 1),
  al AS (SELECT path, count(*) AS parameters FROM a GROUP BY 1), cl AS (SELECT path, string_agg(callee, ',' ORDER BY qualified_name, ordinal) AS calls FROM c GROUP BY 1)
  SELECT path, coalesce(symbols, '') AS symbols, coalesce(imports, '') AS imports, coalesce(parameters, 0) AS parameters, coalesce(calls, '') AS calls
  FROM good LEFT JOIN sl USING (path) LEFT JOIN il USING (path) LEFT JOIN al USING (path) LEFT JOIN cl USING (path)""")
def whole_files(spark, sf_dir):
    """Files with all that was parsed from them, nested."""
    parse = tables(Tables(spark, sf_dir))
    rows = listings.assembled_files(*[parse[n] for n in ("parsed_files", "symbols", "imports", "parameters", "call_sites")])
    by_name = F.array_sort(F.transform("symbols", lambda s: F.struct(s["qualified_name"].alias("q"), s["calls"].alias("c"))), lambda a, b: F.when(a["q"] < b["q"], -1).otherwise(1))
    calls = F.flatten(F.transform(by_name, lambda s: F.transform(s["c"], lambda c: c["callee_expression"])))
    return rows.select(
        "path", F.array_join(F.transform("symbols", lambda s: s["qualified_name"]), ",").alias("symbols"), F.array_join(F.array_sort(F.transform("imports", lambda i: i["module"])), ",").alias("imports"),
        F.aggregate("symbols", F.lit(0), lambda n, s: n + F.size(s["parameters"])).cast("long").alias("parameters"), F.array_join(calls, ",").alias("calls"),
    )


@query(f"""WITH {SOURCES}, al AS (SELECT path, qualified_name, string_agg(position || name || coalesce(':' || annotation, '') || coalesce('=' || default_value, ''), ',' ORDER BY position) AS parameters FROM a GROUP BY 1, 2)
  SELECT kind, name, qualified_name, start_line, end_line, start_column, coalesce(parameters, '') AS parameters, contains(qualified_name, '.') AS nested FROM s LEFT JOIN al USING (path, qualified_name)""")
def answer_symbols(spark, sf_dir):
    """Symbols as clients see them: with their parameters, without bases and calls."""
    parse = tables(Tables(spark, sf_dir))
    rows = responses.symbols(listings.children(parse["symbols"], parse["parameters"], parse["call_sites"]))
    said = F.transform("parameters", lambda p: F.concat(p["position"].cast("string"), p["name"], F.coalesce(F.concat(F.lit(":"), p["annotation"]), F.lit("")), F.coalesce(F.concat(F.lit("="), p["default_value"]), F.lit(""))))
    return rows.select("kind", "name", "qualified_name", "start_line", "end_line", "start_column", F.array_join(said, ",").alias("parameters"), F.col("parent_symbol_id").isNotNull().alias("nested"))


@query(f"""WITH {SOURCES} SELECT 'repository' AS kind, 'R0' AS label, NULL AS language, NULL AS symbol_kind, '2024-01-08T00:00:00+00:00' AS projected_at
  UNION ALL SELECT 'file', path, CASE l WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'javascript' END, NULL, NULL FROM good
  UNION ALL SELECT 'symbol', qualified_name, NULL, kind, NULL FROM s""")
def answer_nodes(spark, sf_dir):
    """Nodes of the projected graph as clients see them, with property maps."""
    parse, bag = tables(Tables(spark, sf_dir)), F.col("properties")
    rows = responses.nodes(graph_nodes(repository(spark), parse["parsed_files"], parse["symbols"], projected()))
    label = F.coalesce(bag["display_name"], bag["path"], bag["qualified_name"])
    return rows.select("kind", label.alias("label"), bag["language"].alias("language"), bag["kind"].alias("symbol_kind"), bag["projected_at"].alias("projected_at"))


def projected():
    from datetime import UTC, datetime

    return datetime(2024, 1, 8, tzinfo=UTC)


def repository(spark) -> DataFrame:
    return spark.createDataFrame([("R0", None, "R0")], "id string, project_id string, display_name string")


@query(f"""WITH {SOURCES} SELECT 'contains' AS kind, 'R0' AS source, path AS target FROM good
  UNION ALL SELECT 'defines', path, qualified_name FROM s UNION ALL SELECT 'contains', split_part(qualified_name, '.', 1), qualified_name FROM s WHERE contains(qualified_name, '.')
  UNION ALL SELECT 'calls', qualified_name, split_part(qualified_name, '.', 1) FROM s WHERE contains(qualified_name, '.')""")
def answer_relationships(spark, sf_dir):
    """The projected graph with both ends named: its structure, and a resolved call of each nested symbol to its parent; the ambiguous ones vanish."""
    parse = tables(Tables(spark, sf_dir))
    state = F.explode(F.array(F.lit("resolved"), F.lit("ambiguous")))
    calls = parse["symbols"].where("parent_symbol_id is not null").withColumn("resolution_status", state)
    calls = fitted(calls.select(F.concat(F.lit("E"), "id").alias("id"), F.lit("R0").alias("repository_id"), F.lit("calls").alias("kind"), "resolution_status", F.col("id").alias("source_symbol_id"), F.col("parent_symbol_id").alias("target_symbol_id"), F.col("qualified_name").alias("raw_target_expression")), DEPENDENCY_EDGES)
    nodes = graph_nodes(repository(spark), parse["parsed_files"], parse["symbols"], None)
    labels = nodes.select("id", F.coalesce("display_name", "path", "qualified_name").alias("label"))
    rows = responses.relationships(graph_edges(parse["parsed_files"], parse["symbols"], calls))
    ends = rows.join(labels.select(F.col("id").alias("source_id"), F.col("label").alias("source")), "source_id").join(labels.select(F.col("id").alias("target_id"), F.col("label").alias("target")), "target_id")
    return ends.select("kind", "source", "target")
