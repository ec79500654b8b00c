"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, mixing, packing, pii, quality, secret_scan, tokencount, topk, toxicity, url_filter
from .common import Workspace, prepare, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.classify(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP2_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(prepare(spark), "packing")
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    narrow = work.save(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return packing.pack(narrow).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(table(spark, sf_dir, "documents"), minhash.Settings(words=4))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("band_kept")).alias("kept"), "ratio", "n_chunks", "n_bad_chunks")


def captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with a fetch day, and dated list entries: neither is in the tables, so both follow from page_id by rule."""
    first = F.lit("2024-01-01").cast("date")
    on = lambda n: F.date_add(first, n.cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", on(F.col("page_id") % 720).alias("fetched"))
    seen = captures.select("page_id", url_filter.host(F.col("url")).alias("host"), F.get(F.split(url_filter.path(F.col("url")), "/"), F.lit(1)).alias("dir")).filter("host is not null")
    hosts = seen.groupBy("host").agg(F.min("page_id").alias("h"))
    dirs = seen.filter("dir <> ''").groupBy("host", "dir").agg(F.min("page_id").alias("h"))
    of_host = lambda r, action, after: hosts.filter(r).select(F.lit("host").alias("kind"), F.col("host").alias("pattern"), F.lit(action).alias("action"), on(F.col("h") * 7 % 500 + after).alias("listed"))
    domain = lambda action, after: hosts.select(F.lit("domain").alias("kind"), F.substring_index("host", ".", -2).alias("pattern"), F.lit(action).alias("action"), on(F.lit(after)).alias("listed")).distinct()
    allowed = dirs.filter("h % 4 = 2").select(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", "dir").alias("pattern"), F.lit("allow").alias("action"), on(F.col("h") * 11 % 400).alias("listed"))
    entries = of_host("h % 3 = 0", "block", 0)
    for more in (of_host("h % 2 = 0", "remove", 120), of_host("h % 5 = 0", "allow", 150), domain("block", 300), domain("remove", 330), allowed):
        entries = entries.unionByName(more)
    return captures, entries


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(*captures_and_entries(spark, sf_dir))


OP6_SQL = r"""
WITH captures AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 720 AS INTEGER) AS DATE) AS fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS steps,
    string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/')[2] AS dir
  FROM pages),
hosts AS (SELECT host, min(page_id) AS h FROM captures WHERE host IS NOT NULL GROUP BY host),
dirs AS (SELECT host, dir, min(page_id) AS h FROM captures WHERE host IS NOT NULL AND dir <> '' GROUP BY host, dir),
entries AS (
  SELECT 'host' AS kind, host AS pattern, 'block' AS action, h * 7 % 500 AS n FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT 'host', host, 'remove', h * 7 % 500 + 120 FROM hosts WHERE h % 2 = 0
  UNION ALL SELECT 'host', host, 'allow', h * 7 % 500 + 150 FROM hosts WHERE h % 5 = 0
  UNION ALL SELECT DISTINCT 'domain', regexp_extract(host, '([^.]*\.)?[^.]*$'), 'block', 300 FROM hosts
  UNION ALL SELECT DISTINCT 'domain', regexp_extract(host, '([^.]*\.)?[^.]*$'), 'remove', 330 FROM hosts
  UNION ALL SELECT 'prefix', host || '/' || dir, 'allow', h * 11 % 400 FROM dirs WHERE h % 4 = 2),
daily AS (
  SELECT kind, lower(pattern) AS key, CAST(DATE '2024-01-01' + CAST(n AS INTEGER) AS DATE) AS since,
    max(CASE action WHEN 'remove' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS strength
  FROM entries GROUP BY ALL),
held AS (SELECT *, lead(since) OVER (PARTITION BY kind, key ORDER BY since) AS until FROM daily),
keys AS (
  SELECT page_id, fetched, 'host' AS kind, host AS key, 10000 AS rank FROM captures WHERE host IS NOT NULL
  UNION ALL SELECT page_id, fetched, 'domain', array_to_string(list_slice(string_split(host, '.'), len(string_split(host, '.')) - i, len(string_split(host, '.'))), '.'), i
    FROM captures, unnest(range(1, len(string_split(host, '.')))) AS u(i) WHERE host IS NOT NULL
  UNION ALL SELECT page_id, fetched, 'prefix', lower(host || '/' || array_to_string(list_slice(steps, 1, i), '/')), 20000 + i
    FROM captures, unnest(range(1, len(steps) + 1)) AS u(i) WHERE host IS NOT NULL),
met AS (
  SELECT k.page_id, k.rank, CASE WHEN h.strength = 3 THEN 'block' ELSE 'allow' END AS action, k.kind || ':' || k.key AS entry
  FROM keys k JOIN held h ON k.kind = h.kind AND k.key = h.key AND h.since <= k.fetched AND (h.until IS NULL OR k.fetched < h.until)
  WHERE h.strength > 1),
best AS (SELECT page_id, count(*) AS n_active, arg_max(entry, rank) AS matched, arg_max(action, rank) AS action FROM met GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched, coalesce(b.n_active, 0) AS n_active, b.matched, CASE WHEN b.action = 'block' THEN 'block' ELSE 'keep' END AS verdict
FROM captures c LEFT JOIN best b USING (page_id)
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lies in the shared folder and stays there: a run goes on from whatever it holds."""
    cache = f"{shared_dir(prepare(spark))}/token-counts"
    counted = tokencount.count(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


TREE = ["domain", "lang", "source"]
#: Target weights by level of the tree; names that aren't here have weight 1.
WEIGHTS = {"domain": {"d0": 1, "d1": 2, "d2": 3}, "lang": {"en": 4, "de": 2, "fr": 2}}


def weight_columns() -> dict:
    return {level: F.coalesce(*(F.when(F.col(level) == name, w) for name, w in of.items())) for level, of in WEIGHTS.items()}


def with_tree(documents: DataFrame) -> DataFrame:
    """Adds domain (a rule on the source's number, there being none in the table) and n_tokens, and makes names non-null."""
    named = documents.withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    number = F.coalesce(F.expr("try_cast(substr(source, 4) as int)"), F.lit(0))
    return named.withColumns({"domain": F.concat(F.lit("d"), F.pmod(number, F.lit(3)).cast("string")), "n_tokens": mixing.words(F.col("text"))})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_tree(table(spark, sf_dir, "documents")).select("doc_id", *TREE, "n_tokens")
    return mixing.mix(rows, TREE, weight_columns(), F.col("total") * 0.6, seed=7, epochs=2)


def _level_sql(name: str, above: str, path: list[str]) -> str:
    """The budgets of one level of the tree: by rising capacity for each unit of weight, filled children first."""
    level, parent = path[-1], path[:-1]
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.get(level, {}).items())
    weight = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    on = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    return f"""
{name}_nodes AS (SELECT {', '.join(path)}, sum(available * 2) AS capacity, {weight} AS weight FROM leaves GROUP BY {', '.join(path)}),
{name}_left AS (
  SELECT n.*, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM {name}_nodes n {on} WINDOW w AS ({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {level})),
{name}_full AS (SELECT *, capacity * weights <= weight * remaining AS is_full FROM {name}_left),
{name}_marked AS (
  SELECT *, max(CASE WHEN NOT is_full THEN weights END) OVER ({by}) AS part_weights, max(CASE WHEN NOT is_full THEN remaining END) OVER ({by}) AS part_left FROM {name}_full),
{name} AS (
  SELECT {', '.join(path)}, CASE WHEN is_full THEN capacity ELSE least(capacity, (weight * greatest(part_left, 0)) // part_weights) END AS budget FROM {name}_marked)"""


OP8_SQL = (
    r"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || CAST(coalesce(TRY_CAST(substr(source, 4) AS INTEGER), 0) % 3 AS VARCHAR) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS available FROM rows GROUP BY ALL),
root AS (SELECT least(CAST(floor(CAST(sum(available) AS DOUBLE) * 0.6) AS HUGEINT), sum(available) * 2) AS budget FROM leaves),"""
    + ",".join(_level_sql(*x) for x in (("one", "root", TREE[:1]), ("two", "one", TREE[:2]), ("three", "two", TREE)))
    + r""",
plan AS (
  SELECT domain, lang, source, available, CAST(budget // greatest(available, 1) AS BIGINT) AS epoch, budget - (budget // greatest(available, 1)) * available AS rest
  FROM leaves JOIN three USING (domain, lang, source)),
taken AS (
  SELECT rows.*, epoch, available > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || epoch || ':' || doc_id)) <= rest AS more
  FROM rows JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch + CAST(more AS INTEGER) AS INTEGER) AS copies FROM taken WHERE epoch + CAST(more AS INTEGER) > 0
"""
)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = [r.kind for r in secret_scan.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, kinds), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["number"] <= len(pii.KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_toxicity, op2_exact_topk, op3_packing, op4_minhash, op5_quality, op6_url_filter, op7_token_counts, op8_mixing, op9_secrets, op10_pii)
}

#: The others need a classifier, a tokenizer, a compressor, full sets or an automaton; their tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op2_exact_topk": OP2_SQL, "op6_url_filter": OP6_SQL, "op8_mixing": OP8_SQL}
