"""Personal data: exact patterns, and information-theoretic sanitisation of the words around them. DataFrame functions only.

The base patterns find protected entities (mail addresses, network addresses, card and phone numbers). Other words
of its documents can reveal it too. From the whole corpus come the documents that hold an entity e, a term t, and both:
    information(e) = log2(N / n_e),  revealed(e; t) = log2(P(e | t) * N / n_e),  disclosure = revealed / information,
the share of the entity's information that the term gives away (1: whoever reads the term knows the entity). Every term of
an entity's documents is scored, however few hold both: P(e | t) = (n_et + prior * n_e / N) / (n_t + prior) is drawn towards the
entity's share of all documents as if ``prior`` more documents held the term, so few documents count as weak evidence.
In the documents of the entity, every occurrence of a term is generalised to its shape from disclosure ``generalise`` on,
and removed from ``remove`` on. Terms are runs of three or more letters outside base spans, in lower case.

Entities that stand in the same documents have the same disclosures, so they are scored as one group (told by the number of
its documents and 128 bits of hashes over them): a document with many entities of its own has its terms scored once.

Positions come from splitting a text at its matches and summing the lengths of parts and matches, one row for each
match, so nothing grows with the square of a text's matches. The patterns are written with possessive repeats
and look-behinds; they match what the plain patterns match, without their backtracking.

Defined results: null counts as empty and has no spans; positions are code points, ends exclusive; matches that fail
their test are dropped and use up their text; repeated rows are handled each; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a passing match has at least.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_WORD = r"\p{L}{3,}"


@dataclass(frozen=True)
class Settings:
    prior: float = 9.0
    generalise: float = 0.5
    remove: float = 0.8


def _hits(text: Column, kind: str) -> Column:
    """Array of (kind, place, gap before, match) of all matches of a kind."""
    matches, parts = F.regexp_extract_all(text, F.lit(_PATTERN[kind]), 0), F.split(text, _PATTERN[kind], -1)
    hinted = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINT[kind])
    row = lambda m, i, p: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(F.get(p, i)).alias("gap"), m.alias("match"))
    made = F.get(F.transform(F.array(F.struct(matches.alias("m"), parts.alias("p"))), lambda x: F.transform(x["m"], lambda m, i: row(m, i, x["p"]))), F.lit(0))
    return F.when(hinted, made).otherwise(F.array().cast("array<struct<kind:string,place:int,gap:int,match:string>>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes() -> Column:
    match, digits = F.col("match"), _digits(F.col("match"))
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
    # doubled digits, minus 9 where beyond 9, from the second on the right
    luhn = F.aggregate(F.transform(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), lambda d, i: F.when(i % 2 == 1, d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)).otherwise(d.try_cast("int"))), F.lit(0), lambda a, d: a + d)
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(F.col("kind") == "card", F.when(F.length(digits).between(16, 19), luhn % 10 == 0).otherwise(False))
        .otherwise(F.length(digits).between(8, 15))
    )


def spans(documents: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows as (row, doc_id), the passing base spans (row, kind, start, end, entity), and the texts (row, text) of their rows."""
    text = F.col("__text")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("__text"))
    # the numbers of rows hold for this one run only, so texts with matches are written with them
    found = rows.select("row", "doc_id", F.concat(*(_hits(text, k) for k in KINDS)).alias("hits"), text)
    hits = work.save(found.select("row", "doc_id", "hits", F.when(F.size("hits") > 0, text).alias("text")), "hits")
    order = Window.partitionBy("row", "kind").orderBy("place")
    placed = hits.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").repartition("row").withColumn("end", F.sum(F.col("gap") + F.length("match")).over(order).cast("int"))
    entity = F.concat(F.col("kind"), F.lit(":"), F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(F.lower("match")))
    kept = work.save(placed.filter(_passes()).select("row", "kind", (F.col("end") - F.length("match")).alias("start"), "end", entity.alias("entity")), "spans")
    return hits.select("row", "doc_id"), kept, hits.filter(F.col("text").isNotNull()).select("row", "text").join(kept.select("row").distinct(), "row", "left_semi")


def occurrences(base: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, start, end, term) of every term in the texts, cut where a base span begins or ends in it."""
    matches = F.regexp_extract_all("text", F.lit(_WORD), 0)
    each = texts.select("row", F.posexplode(F.arrays_zip(matches.alias("m"), F.split("text", _WORD, -1).alias("p"))).alias("place", "z")).filter(F.col("z.m").isNotNull())
    upto = F.sum(F.length("z.p") + F.length("z.m")).over(Window.partitionBy("row").orderBy("place")).cast("int")
    words = each.select("row", F.col("z.m").alias("word"), upto.alias("end")).select("row", (F.col("end") - F.length("word")).alias("start"), "end", "word")
    # both frames end at the current row: those that begin there take the square of a document's words
    upward, downward = (Window.partitionBy("row").orderBy(o, F.col("word").isNotNull()).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("start"), F.desc("start")))
    is_base = F.col("word").isNull()
    covered = F.max(F.when(is_base, F.col("end"))).over(upward)
    following = F.min(F.when(is_base, F.col("start"))).over(downward)
    mixed = words.unionByName(base.select("row", "start", "end", F.lit(None).cast("string").alias("word"))).withColumns({"__covered": covered, "__following": following}).filter("word is not null")
    cut = mixed.select("row", F.greatest("start", "__covered").alias("from"), F.least("end", "__following").alias("upto"), "start", "word").filter(F.col("upto") - F.col("from") >= 3)
    return cut.select("row", F.col("from").alias("start"), F.col("upto").alias("end"), F.lower(F.substring("word", F.col("from") - F.col("start") + 1, F.col("upto") - F.col("from"))).alias("term"))


def disclosing(documents: DataFrame, base: DataFrame, texts: DataFrame, settings: Settings, work: Workspace) -> DataFrame:
    """(row, kind, start, end) of the terms that give away an entity of their document: kind is an action."""
    terms = work.save(occurrences(base, texts), "terms")
    held = base.select("row", "entity").distinct()
    sets = held.groupBy("entity").agg(F.count("*").alias("n_e"), F.expr("bit_xor(xxhash64(row))").alias("x"), F.expr("bit_xor(xxhash64(row, 1))").alias("y"))
    group = F.struct("n_e", "x", "y")
    groups = work.save(held.join(sets, "entity").select("row", group.alias("group")).distinct(), "groups")
    pairs = work.save(terms.select("row", "term").distinct().join(groups, "row"), "pairs")
    words = F.array_distinct(F.split(F.lower(F.array_join(F.regexp_extract_all(text_or_empty(), F.lit(_WORD), 0), " ")), " "))
    n_t = work.save(documents.select(F.explode(words).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("n_t")), "n_t")
    total = documents.count()
    part = F.col("group.n_e") / F.lit(float(total))
    # a word cut at a base span may stand nowhere as a whole word
    in_all = F.greatest(F.coalesce("n_t", F.lit(0)), F.col("n_et"))
    share = F.log2((F.col("n_et") + settings.prior * part) / ((in_all + settings.prior) * part)) / F.log2(1 / part)
    counted = pairs.groupBy("group", "term").agg(F.count("*").alias("n_et")).filter(F.col("group.n_e") < total)
    scored = counted.join(n_t, "term", "left").withColumn("share", share).filter(F.col("share") >= settings.generalise)
    strong = work.save(scored.select("group", "term", F.when(F.col("share") >= settings.remove, ACTIONS[1]).otherwise(ACTIONS[0]).alias("kind")), "disclosing")
    # a term that gives away several entities of its document gets the stronger action
    marked = pairs.join(strong, ["group", "term"]).groupBy("row", "term").agg(F.max("kind").alias("kind"))
    return terms.join(marked, ["row", "term"]).select("row", "kind", "start", "end")


def find(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, spans: array of (kind number, kind, start, end), base kinds first, each by start) of every row."""
    work = Workspace(documents.sparkSession, "pii")
    rows, base, texts = spans(documents, work)
    added = disclosing(documents, base, texts, settings, work)
    number = F.array_position(F.array(*map(F.lit, KINDS + ACTIONS)), F.col("kind")).cast("int")
    empty = rows.withColumns({"kind": F.lit(None).cast("string"), "start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
    spread = lambda found: found.select("row", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end")
    every = empty.unionByName(spread(base)).unionByName(spread(added))
    one = F.when(F.col("kind").isNotNull(), F.struct(number.alias("number"), F.col("start"), F.col("end"), F.col("kind")))
    return every.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sort_array(F.collect_list(one)).alias("spans")).drop("row")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with ``text`` sanitised: base entities and removed terms become [KIND], generalised terms their shape.

    Rows are matched by doc_id and text; a null text stays null."""
    names = documents.columns
    known = documents.groupBy("doc_id", "text").agg(F.count("*").alias("__copies")).drop("__copies")
    work = Workspace(documents.sparkSession, "sanitise")
    numbered = work.save(known.withColumn("__key", F.monotonically_increasing_id()), "texts")
    found = find(numbered.select(F.col("__key").alias("doc_id"), "text"), settings).select(F.col("doc_id").alias("__key"), F.explode("spans").alias("s")).select("__key", "s.*")
    order = Window.partitionBy("__key").orderBy("start", "number")
    clear = found.withColumn("upto", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("start") >= F.col("upto"))
    lists = clear.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cut"))
    text, cut = F.col("text"), F.col("cut")
    shape = lambda x: F.regexp_replace(F.regexp_replace(x, r"\p{Lu}", "X"), r"\p{Ll}", "x")
    instead = lambda s: F.when(s["kind"] == ACTIONS[0], shape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"])
    made = F.concat(F.array_join(F.transform(cut, lambda s, i: F.concat(F.substring(text, upto(i) + 1, s["start"] - upto(i)), instead(s))), ""), F.substring(text, F.get(cut, F.size(cut) - 1)["end"] + 1, F.length(text)))
    clean = numbered.join(lists, "__key", "left").select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.when(cut.isNotNull(), made).otherwise(text).alias("__clean"))
    met = documents.join(clean, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text").eqNullSafe(F.col("__text")))
    return met.select(*(F.col("__clean").alias("text") if c == "text" else F.col(c) for c in names))
