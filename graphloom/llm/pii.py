"""Personal data by patterns and by information theory, in native Spark expressions only.

Patterns give the protected entities.  An entity has several keys: its value, its parts
(an e-mail's domain and the words of its local part, the leading numbers of an IP, a card
or a phone) and its kind.  Most values stand in one document only, so that nothing can be
learnt about them alone; their parts and kinds are shared.  Terms are the words of a text
once its entities are blanked; over the whole corpus we count the documents of each key
(n_e), of each term (n_t) and of the two together (n_et), at whatever distance.  Pointwise
mutual information against the key's information content,

    disclosure = log2(N n_et / (n_e n_t)) / log2(N / n_e)   (1: the term gives it away),

says how strongly a term reveals the key.  Terms at or over `generalise_at` are
generalised, those at or over `remove_at` removed, wherever they stand in a document that
holds an entity with that key.  Terms need `support` documents with the key, so that one chance
meeting is no evidence.  Parts and kinds meet many terms by chance, so theirs must also be
significant: with p = n_et / n_t and q = n_e / N the chance of so many meetings is at most
exp(-n_t KL(p || q)) (Chernoff), and this, times a bound on the number of pairs tested
(Bonferroni: for each part or kind its meetings with terms by `support`, or all terms if
they are fewer), may not exceed `ALPHA`.

Few terms can reach the threshold with any key: at least (support / N) ** (1 - generalise_at)
of a term's documents must hold an entity of one kind.  Others are set aside, without loss,
before keys and terms are paired.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ID, TEXT, id_text, stored

#: Entity kinds in order, with their patterns.  Possessive loops and the look-behinds
#: change no match; they keep long runs linear and off the call stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that each kind cannot do without; texts that lack it are skipped.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"\p{L}{3,}"
#: Array items handled before their output is set aside.
CHUNK = 256
SUPPORT, GENERALISE_AT, REMOVE_AT = 2, 0.9, 0.999
#: Rows of a table of terms that is broadcast at most (8 to 24 bytes each); longer ones are shuffled with what they meet.
BROADCAST_TERMS = 1_000_000
#: The chance that any term of a part or kind is marked by coincidence.
ALPHA = 0.01
EMPTY = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def fenced(text: Column, pattern: str) -> Column:
    """The text cut at a pattern's leftmost matches: every second part is a match.

    Matches are fenced with a control character that no pattern can hold."""
    return F.split(F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$0\x01"), "\x01", -1)


def collected(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], empty: Column) -> Column:
    """What step puts out over an array, in order: step(state, item) gives the next state and an array.

    Output is gathered in chunks that are joined at the end, so that long arrays do not
    cost the square of their length.  items should be a column, not an expression."""

    def inner(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), empty.alias("out")), inner)
        # through a one-element array, so that the part is evaluated once
        return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["state"].alias("state"), F.concat(acc["chunks"], F.array(p["out"])).alias("chunks"))), 1)

    first = F.struct(state.alias("state"), F.slice(F.array(empty), 1, 0).alias("chunks"))
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK) - 1, F.lit(0)).cast("int"))
    return F.flatten(F.aggregate(chunks, first, outer, lambda acc: acc["chunks"]))


def matches(parts: Column) -> Column:
    """Array of (start, end, value) of the matches among fenced parts, in code points."""

    def step(state: Column, part: Column) -> tuple[Column, Column]:
        end = state["at"] + F.length(part)
        hit = F.struct(state["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside")), F.when(state["inside"], F.array(hit)).otherwise(F.expr(EMPTY))

    return collected(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside")), step, F.expr(EMPTY))


def digits(value: Column) -> Column:
    return F.translate(value, " ().+-", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.ltrim(p, F.lit("0")) > "255", 2).otherwise(3))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def parts_of(text: Column, kind: str) -> Column:
    """Fenced parts of one kind; null where the text cannot hold that kind."""
    parts = fenced(text, PATTERNS[kind])
    return F.when(F.contains(text, F.lit(NEEDS[kind])), parts) if NEEDS[kind] else parts


def entities(parts: dict[str, Column]) -> Column:
    """Array of (start, rank, kind, end, value) of all valid matches, by start, then kind."""
    return F.array_sort(F.concat(*[of_kind(parts[kind], rank, kind) for rank, kind in enumerate(PATTERNS)]))


def of_kind(parts: Column, rank: int, kind: str) -> Column:
    hits = F.filter(F.when(F.size(parts) > 1, matches(parts)).otherwise(F.expr(EMPTY)), lambda h: valid(kind, h["value"]))
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h["end"].alias("end"), h["value"].alias("value")))


def parts_of_value(kind: Column, value: Column) -> Column:
    """What an entity shares with others of its kind, as an array of strings."""
    number = digits(value)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(F.array(domain), F.regexp_extract_all(local, F.lit(TERM), 0))
    ip = F.array(F.substring_index(value, ".", 2), F.substring_index(value, ".", 3))
    phone = F.array(F.left(number, F.length(number) - 7), F.left(number, F.length(number) - 4))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).otherwise(F.array(F.left(number, F.lit(6))))


def keys(span: Column) -> Column:
    """Array of (key, whole) of an entity: hashes of its value (whole), its parts and its kind."""
    kind, value = span["kind"], F.lower(span["value"])
    parts = F.transform(F.array_distinct(parts_of_value(kind, value)), lambda p: F.struct(F.xxhash64(F.lit("part"), kind, p).alias("key"), F.lit(False).alias("whole")))
    return F.concat(F.array(F.struct(F.xxhash64(kind, value).alias("key"), F.lit(True).alias("whole")), F.struct(F.xxhash64(kind).alias("key"), F.lit(False).alias("whole"))), parts)


def keys_of(spans: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, keys)))


def significant(n_et: Column, n_t: Column, n_e: Column, total: float, tests: int) -> Column:
    """Whether n_et meetings among n_t are too many to be chance among `tests` pairs."""
    p, q = n_et / n_t, n_e / F.lit(total)
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    return n_t * (p * F.log(p / q) + rest) >= math.log(max(tests, 1) / ALPHA)


def left_of(text: Column, spans: Column) -> Column:
    """The text with every entity blanked, at the same length in code points."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        kept = F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        blank = F.repeat(F.lit("\x02"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))
        return F.greatest(s["end"], at), F.array(F.concat(kept, blank))

    pieces = collected(spans, F.lit(0), step, F.expr("cast(array() as array<string>)"))
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))


def terms_of(text: Column) -> Column:
    """The distinct words of a text, as hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), lambda w: F.xxhash64(F.lower(w))))


def checked(rows: DataFrame) -> DataFrame:
    """A stored table of terms, marked for broadcasting if it is short enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows


def meetings(holders: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, body, entity, whole, term) wherever an entity's key and one of the terms are in a document."""
    some = terms if terms.columns == ["term"] else terms.select("term").distinct()
    met = holders.select(ID, "body", "keys", F.explode("terms").alias("term")).join(checked(some), "term", "left_semi")
    return met.select(ID, "body", "term", F.explode("keys").alias("k")).select(ID, "body", F.col("k.key").alias("entity"), F.col("k.whole").alias("whole"), "term")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """One row per input row: id, spans = array of (start, rank, kind, end, action) by start, then kind.

    Kinds are email, ip, card, phone (action `mask`) and term (action `generalise` or
    `remove`); places are code points, end exclusive.  Null texts count as empty and have
    no spans.  Rows that repeat id and text get the same spans each.  Documents are the
    units of all counts, repeated rows included.  An empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    # entities are found once; words and keys are stored, without texts, for rows that hold any
    cut = rows.withColumns({f"__{kind}": parts_of(F.col(TEXT), kind) for kind in PATTERNS})
    marked = cut.withColumn("spans", entities({kind: F.col(f"__{kind}") for kind in PATTERNS})).withColumn("holds", F.size("spans") > 0)
    left = marked.withColumn("left", F.when(F.col("holds"), left_of(F.col(TEXT), F.col("spans"))))
    fields = left.withColumn("fenced", F.when(F.col("holds"), fenced(F.col("left"), TERM)))  # a column of its own: it is read many times
    found = fields.withColumn("words", F.when(F.col("holds"), F.transform(matches(F.col("fenced")), lambda w: F.struct(F.xxhash64(F.lower(w["value"])).alias("term"), w["start"].alias("start"), w["end"].alias("end")))))
    named = found.withColumn("terms", F.array_distinct(F.col("words")["term"])).withColumn("whole", F.when(F.col("holds"), terms_of(F.col(TEXT))))
    # words that stand only inside entities, and words that only their blanking makes
    base = named.select(ID, F.xxhash64(TEXT).alias("body"), "spans", "holds", "words", "terms", F.array_except("whole", "terms").alias("gone"), F.array_except("terms", "whole").alias("come"))
    base = stored(base, "entities")
    total = base.count()
    holders = base.where("holds").select(ID, "body", "words", "terms", "gone", "come", keys_of(F.col("spans")).alias("keys"), *[F.array_contains(F.col("spans")["kind"], kind).cast("int").alias(f"h_{kind}") for kind in PATTERNS])
    # a term is met by an entity's keys in no more documents than hold an entity of that kind
    kinds = [f"h_{kind}" for kind in PATTERNS]
    beside = holders.select(F.explode("terms").alias("term"), *kinds).groupBy("term").agg(*[F.sum(k).alias(k) for k in kinds])
    beside = stored(beside.withColumn("most", F.greatest(*kinds)).where(F.col("most") >= support).select("term", "most"), "beside")
    # words of whole texts, put right for the rows whose entities are blanked; only those that may matter are counted
    counted = [rows.select(F.explode(terms_of(F.col(TEXT))).alias("term"), F.lit(1).alias("n")), holders.select(F.explode("gone").alias("term"), F.lit(-1).alias("n")), holders.select(F.explode("come").alias("term"), F.lit(1).alias("n"))]
    some = checked(beside.select("term"))
    n_t = None
    for part in counted:
        part = part.join(some, "term", "left_semi")
        n_t = part if n_t is None else n_t.unionAll(part)
    n_t = n_t.groupBy("term").agg(F.sum("n").alias("n_t"))
    # disclosure >= g means n_et / n_t >= (n_e / N) ** (1 - g), and n_e >= support: other terms reveal nothing
    floor = (support / max(total, support)) ** max(0.0, 1 - generalise_at) * (1 - 1e-9)
    able = stored(beside.join(n_t, "term").where(F.col("most") >= F.col("n_t") * floor).select("term", "n_t"), "able")
    each_key = holders.select(F.explode("keys").alias("k"), F.size("terms").alias("m")).groupBy(F.col("k.key").alias("entity"), F.col("k.whole").alias("whole"))
    n_e = stored(each_key.agg(F.count(F.lit(1)).alias("n_e"), F.sum("m").alias("met")).where(F.col("n_e") >= support), "keys")
    pairs = meetings(holders, able)
    n_et = pairs.groupBy("entity", "whole", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    # a part or kind is tested against no more terms than there are, nor more than its meetings by `support`
    most_terms = F.lit(beside.count())
    tests = n_e.where("not whole").agg(F.sum(F.least(F.floor(F.col("met") / support), most_terms))).first()[0] or 0
    information = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    shared = F.log2(F.lit(float(max(total, 1))) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    evident = F.col("whole") | significant(F.col("n_et"), F.col("n_t"), F.col("n_e"), float(max(total, 1)), tests)
    revealing = n_et.join(n_e.select("entity", "n_e"), "entity").join(able, "term").withColumn("disclosure", F.when(information > 0, shared / information).otherwise(0.0)).where((F.col("disclosure") >= generalise_at) & evident)
    revealing = stored(revealing.select("entity", "term", "disclosure"), "revealing")
    # back to the places: every occurrence in the rows that hold an entity with the key
    action = F.when(F.max("disclosure") >= remove_at, "remove").otherwise("generalise")
    hits = meetings(holders, revealing).join(checked(revealing), ["entity", "term"]).groupBy(F.col(ID).alias("its"), F.col("body").alias("its_body"), F.col("term").alias("its_term")).agg(action.alias("action"))
    places = holders.select(ID, "body", F.explode("words").alias("c")).select(ID, "body", "c.*").distinct()
    terms = places.join(hits, F.col(ID).eqNullSafe(F.col("its")) & (F.col("body") == F.col("its_body")) & (F.col("term") == F.col("its_term"))).select(ID, "body", "start", "end", "action")
    struct = F.struct("start", F.lit(len(PATTERNS)).alias("rank"), F.lit("term").alias("kind"), "end", "action")
    per_row = terms.groupBy(F.col(ID).alias("its"), F.col("body").alias("its_body")).agg(F.collect_list(struct).alias("terms"))
    masked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("mask").alias("action")))
    kept = base.select(ID, "body", masked.alias("spans"))
    joined = kept.join(stored(per_row, "terms"), F.col(ID).eqNullSafe(F.col("its")) & (F.col("body") == F.col("its_body")), "left")
    return joined.select(F.col(ID).alias(id_col), F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "terms"))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities masked by kind, terms generalised to [term] or removed.

    Where spans overlap, the one that begins first wins and the rest of the other goes with it."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        said = F.when(s["action"] == "mask", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["action"] == "generalise", "[term]").otherwise("")
        kept = F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.greatest(s["end"], at), F.array(F.concat(kept, F.when(s["start"] >= at, said).otherwise("")))

    pieces = collected(spans, F.lit(0), step, F.expr("cast(array() as array<string>)"))
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))
