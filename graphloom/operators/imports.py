"""Import resolution: which file of the repository an import names.

Inputs are the tables parsed_files and imports; the result is the imports with
resolution_status, target_file_id and detail.
All imports are resolved at once by equi joins on candidate paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import climb, collapsed, join, normalized, parent, proper_suffixes, segments, slashed
from ..functions.shaping import quoted
from ..scratch import stored

#: In order of preference.
PYTHON_ENDINGS = (".py", "/__init__.py")
ECMASCRIPT_ENDINGS = (".ts", "/index.ts", ".tsx", "/index.tsx", ".js", "/index.js", ".jsx", "/index.jsx")
NO_NAMES = "cast(array() as array<string>)"


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """imports with resolution_status, target_file_id and detail, row by row, by the rule of each file's language.

    The path that each import names is worked out once and stored with it.  Distinct paths meet the
    files, and what they find is joined back by path: however many imports name a module, it is
    looked up once.  Ids of imports may repeat.  Unknown languages stay unresolved; imports of
    unknown files are left out."""
    # folders are worked out once for each file, not for each of its imports
    source = files.select(F.col("id").alias("file_id"), "language", parent(normalized(F.col("path"))).alias("__folder"), parent(slashed(F.col("path"))).alias("__beside"))
    named = imports.join(source, "file_id").withColumn("names", F.coalesce("imported_names", F.expr(NO_NAMES)))
    python, module = F.col("language") == "python", F.col("module")
    relative = F.col("language").isin("javascript", "typescript") & F.startswith(module, F.lit("."))
    aimed = F.when(python, python_target(F.col("__folder"), module, F.col("names"))).when(relative, beside(F.col("__beside"), module))
    refs = stored(named.select(*[F.col(c) for c in imports.columns], F.col("language").alias("__language"), F.col("names").alias("__names"), aimed.alias("__target")), "references")
    python = refs.where("__language = 'python'")
    ecmascript = refs.where("__language in ('javascript', 'typescript')")
    other = refs.where("__language not in ('python', 'javascript', 'typescript') or __language is null")
    none = outcome(other, F.concat(F.lit("there is no rule for files of language "), quoted(F.coalesce("__language", F.lit("None")))))
    results = resolve_python(files, python).unionByName(resolve_ecmascript(files, ecmascript)).unionByName(none)
    return results.drop("__language", "__names", "__target")


def outcome(refs: DataFrame, detail: Column, status: str = "unresolved") -> DataFrame:
    """refs that have no target, with the reason."""
    return refs.withColumns({"resolution_status": F.lit(status), "target_file_id": F.lit(None).cast("string"), "detail": detail})


def stems(paths: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """paths with (stem, rank) for each ending that `path` has, the ending taken off."""
    path = F.col("path")
    each = [F.when(F.endswith(path, F.lit(e)), F.struct(F.expr(f"left(path, length(path) - {len(e)})").alias("stem"), F.lit(i).alias("rank"))) for i, e in enumerate(endings)]
    return paths.withColumn("of", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))).select(*paths.columns, "of.stem", "of.rank")


# ---- Python ---------------------------------------------------------------------


def python_target(folder: Column, module: Column, names: Column) -> Column:
    """Path, without ending, that a module text names; null where one name cannot be told."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.*", "")
    base = F.when(dots == 1, folder).otherwise(climb(folder, dots - 1))
    below = F.regexp_replace(F.translate(rest, ".", "/"), "/+", "/")
    return F.when(dots == 0, below).when(rest != "", join(base, below)).when(F.size(names) == 1, join(base, F.get(names, F.lit(0))))


def resolve_python(files: DataFrame, refs: DataFrame) -> DataFrame:
    bare = F.rlike(F.col("module"), F.lit(r"^\.+$"))
    shown = F.when(bare, F.concat("module", F.get("__names", F.lit(0)))).otherwise(F.col("module"))
    many = outcome(refs.where("__target is null"), F.concat(quoted(F.col("module")), F.lit(" stands for as many files as it has names: "), F.size("__names").cast("string")), "ambiguous")
    one = refs.where("__target is not null").withColumns({"__deep": segments(F.col("__target")) > 1, "__target": F.regexp_replace("__target", r"^[./]+", "")})
    wanted = one.select("repository_id", "__target", "__deep").distinct()
    # a file can be named by its whole path or, for targets of several parts, by a tail of it that begins below some source root
    known = files.where("language = 'python'").select("repository_id", F.col("id").alias("hit"), normalized(F.col("path")).alias("whole"))
    tails = F.filter(proper_suffixes(F.col("whole")), lambda t: F.contains(t, F.lit("/")))
    places = stems(known.withColumn("path", F.explode(F.concat(F.array("whole"), tails))), PYTHON_ENDINGS)
    marked = places.select("repository_id", F.col("stem").alias("__target"), "hit", "whole", F.col("rank").cast("string").alias("rank"), (F.col("path") == F.col("whole")).alias("exact"))
    hits = wanted.join(marked, ["repository_id", "__target"]).where("exact or __deep")
    # tails count only where there is no exact hit; a file meets a target once at most
    some = hits.groupBy("repository_id", "__target", "__deep").agg(
        F.count_if("exact").alias("n_exact"), F.min_by("hit", F.when(F.col("exact"), F.col("rank"))).alias("exact_hit"),
        F.count_if(~F.col("exact")).alias("n_tail"), F.min_by("hit", F.when(~F.col("exact"), F.col("whole"))).alias("tail_hit"),
    )
    exact = F.col("n_exact") > 0
    found = some.select("repository_id", "__target", "__deep", F.when(exact, F.col("n_exact")).otherwise(F.col("n_tail")).alias("n"), F.when(exact, F.col("exact_hit")).otherwise(F.col("tail_hit")).alias("target_file_id"))
    nothing = F.concat(F.lit("no file here fits "), quoted(shown), F.lit("; it may come from elsewhere"))
    return counted(one, found, ["repository_id", "__target", "__deep"], shown, nothing).drop("__deep").unionByName(many)


# ---- JavaScript and TypeScript ----------------------------------------------------


#: A part that is empty, '.' or '..'.
DOTTED = r"(^|/)\.{0,2}(/|$)"


def beside(folder: Column, module: Column) -> Column:
    """collapsed(join(folder, module)); the common ./name and ../name go without taking the path to parts."""
    plain = (folder != ".") & ~F.rlike(folder, F.lit(DOTTED))
    near, above = F.substring(module, 3, 1 << 30), F.substring(module, 4, 1 << 30)
    return (
        F.when(plain & F.startswith(module, F.lit("./")) & ~F.rlike(near, F.lit(DOTTED)), F.concat(folder, F.lit("/"), near))
        .when(plain & F.startswith(module, F.lit("../")) & ~F.rlike(above, F.lit(DOTTED)), join(parent(folder), above))
        .otherwise(collapsed(join(folder, module)))
    )


def resolve_ecmascript(files: DataFrame, refs: DataFrame) -> DataFrame:
    relative = F.startswith("module", F.lit("."))
    bare = outcome(refs.where(~relative), F.concat(quoted(F.col("module")), F.lit(" names a package, and packages lie outside")))
    one = refs.where(relative)
    known = stems(files.where("language in ('javascript', 'typescript')").select("repository_id", F.col("id").alias("hit"), "path"), ECMASCRIPT_ENDINGS)
    hits = one.select("repository_id", "__target").distinct().join(known.withColumnRenamed("stem", "__target"), ["repository_id", "__target"])
    found = hits.groupBy("repository_id", "__target").agg(F.count_distinct("hit").alias("n"), F.min_by("hit", "rank").alias("target_file_id"))
    return counted(one, found, ["repository_id", "__target"], F.col("module"), F.concat(F.lit("no file here fits "), quoted(F.col("module")))).unionByName(bare)


def counted(refs: DataFrame, found: DataFrame, keys: list[str], shown: Column, nothing: Column) -> DataFrame:
    """refs with what their targets found.  No hit: unresolved.  One file: resolved.  Several: ambiguous, the first in order is kept."""
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    several = F.concat(n.cast("string"), F.lit(" files here fit "), quoted(shown))
    joined = refs.join(found, keys, "left")
    return joined.withColumns({"resolution_status": status, "detail": F.when(n == 0, nothing).when(n > 1, several)}).select(*refs.columns, "resolution_status", "target_file_id", "detail")
