"""DuckDB SQL for the registered queries, put together from common table expressions.

Written from the definitions, not from the DataFrame plans, so that the two can be held against each other."""

from __future__ import annotations

PX = """px AS (
  SELECT vec_id // 16 AS image, vec_id % 16 AS y, CAST(i - 1 AS BIGINT) AS x,
    CAST(CASE WHEN v < CAST(-0.1 AS FLOAT) THEN 0 WHEN v < CAST(0 AS FLOAT) THEN 1 WHEN v < CAST(0.1 AS FLOAT) THEN 2 ELSE 3 END AS BIGINT) AS label
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def run_ctes(source: str, keys: str, name: str = "runs") -> str:
    return f"""{name}_b AS (SELECT *, lag(label) OVER (PARTITION BY {keys}, y ORDER BY x) AS before, max(x + 1) OVER (PARTITION BY {keys}, y) AS w FROM {source}),
{name} AS (
  SELECT {keys}, y, row_number() OVER r - 1 AS run_idx, x AS start_x, coalesce(lead(x) OVER r, w) - x AS len, label, w
  FROM {name}_b WHERE before IS NULL OR before <> label WINDOW r AS (PARTITION BY {keys}, y ORDER BY x))"""


RUNS = f"{PX},\n{run_ctes('px', 'image')}"
SIZES = "sizes AS (SELECT image, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY image)"
TRAIN = "(image // 4) % 5 <> 0"
LI = """li AS (
  SELECT l_suppkey // 10 AS sample, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS t, l_suppkey % 10 AS y,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day FROM lineitem),
span AS (SELECT min(day) AS first, (max(day) - min(day)) // 7 AS weeks FROM li),
cells AS (SELECT sample, t, y, (day - first) // 7 AS x, CAST(least(count(*), 3) AS BIGINT) AS label FROM li, span GROUP BY ALL),
grid AS (SELECT sample, t, y, x FROM (SELECT DISTINCT sample FROM li), (SELECT unnest(range(0, 3)) AS t), (SELECT unnest(range(0, 10)) AS y), (SELECT unnest(range(0, weeks + 1)) AS x FROM span)),
pl AS (SELECT sample, t, y, x, coalesce(label, 0) AS label FROM grid LEFT JOIN cells USING (sample, t, y, x))"""
SCAN = f"""{PX},
{SIZES},
flat AS (SELECT image, y * w + x AS p, CAST(label > 1 AS BIGINT) AS value, h, w FROM px JOIN sizes USING (image)),
flat_b AS (SELECT *, lag(value) OVER (PARTITION BY image ORDER BY p) AS before FROM flat),
lines AS (
  SELECT image, h, w, row_number() OVER r - 1 AS run_idx, coalesce(lead(p) OVER r, h * w) - p AS len, value
  FROM flat_b WHERE before IS NULL OR before <> value WINDOW r AS (PARTITION BY image ORDER BY p))"""
ABOVE = f"""{RUNS},
over_ AS (SELECT image, y + 1 AS y, unnest(range(start_x, start_x + len)) AS start_x, label AS al, start_x + len AS ae FROM runs),
feat AS (
  SELECT r.*, coalesce(al, -2) AS above_label, greatest(1, coalesce(ae - r.start_x, 1)) AS above_rem,
    lag(r.label, 1, -1) OVER (PARTITION BY r.image, r.y ORDER BY r.run_idx) AS prev, least(8 * r.start_x // r.w, 7) AS xb
  FROM runs r LEFT JOIN over_ USING (image, y, start_x)),
rows_ AS (SELECT *, least(CAST(floor(log2(above_rem + 0.5)) AS BIGINT), 3) AS lb FROM feat)"""


def label_ctes(order: int, reset: bool, source: str = "runs", out: str = "lb_bits", train: str = TRAIN) -> str:
    by = "PARTITION BY image, y ORDER BY run_idx" if reset else "PARTITION BY image ORDER BY y, run_idx"
    ctx = [f"p{k}" for k in range(1, order)]
    lags = "".join(f", lag(label, {k}, -1) OVER ({by}) AS p{k}" for k in range(1, order))
    using = ", ".join([*ctx, "label"])
    totals = f"SELECT {', '.join(ctx)}, sum(c) AS n FROM {out}_c GROUP BY ALL" if ctx else f"SELECT sum(c) AS n FROM {out}_c"
    join = f"LEFT JOIN {out}_t USING ({', '.join(ctx)})" if ctx else f"CROSS JOIN {out}_t"
    return f"""{out}_x AS (SELECT *{lags} FROM {source}),
{out}_c AS (SELECT {using}, count(*) AS c FROM {out}_x WHERE {train} GROUP BY ALL),
{out}_t AS ({totals}),
{out}_v AS (SELECT greatest(count(DISTINCT label), 1) AS v FROM {out}_x WHERE {train}),
{out}_k AS (SELECT DISTINCT label, 1 AS known FROM {out}_x WHERE {train}),
{out} AS (
  SELECT x.*, CASE WHEN known IS NULL THEN log2(v) ELSE -log2((coalesce(c, 0) + 0.5::DOUBLE) / (coalesce(n, 0) + 0.5::DOUBLE * v)) END AS bits_label
  FROM {out}_x x LEFT JOIN {out}_c USING ({using}) {join} LEFT JOIN {out}_k USING (label) CROSS JOIN {out}_v)"""


LEN_KEYS = {"label": ([], 0.0), "bigram": (["prev", "label"], 0.95), "xbin": (["label", "xb"], 0.8), "above": (["label", "above_label"], 0.8), "above_lenbin": (["label", "above_label", "lb"], 0.8)}


def length_ctes(mode: str, source: str = "rows_", out: str = "len_bits") -> str:
    """Counts per key as sums over training runs; no cumulative tables here, unlike in the engine."""
    keys, weight = LEN_KEYS[mode]
    levels = {"g": [], "b": ["label"]} | ({"s": keys} if keys else {})
    parts, joins = [], []
    for tag, by in levels.items():
        cols = "".join(f"{c}, " for c in by)
        on = " AND ".join(f"a.{c} = d.{c}" for c in by) or "true"
        parts.append(f"{out}_{tag}n AS (SELECT {cols}len, count(*) AS c FROM {source} WHERE {TRAIN} GROUP BY ALL)")
        parts.append(f"{out}_{tag}t AS (SELECT {cols}sum(c) AS t FROM {out}_{tag}n GROUP BY ALL)" if by else f"{out}_{tag}t AS (SELECT sum(c) AS t FROM {out}_{tag}n)")
        parts.append(f"""{out}_{tag}q AS (
  SELECT {''.join(f'd.{c}, ' for c in by)}d.len AS l, d.k, sum(CASE WHEN a.len = d.len THEN a.c ELSE 0 END) AS c, sum(CASE WHEN a.len <= d.k THEN a.c ELSE 0 END) AS u
  FROM (SELECT DISTINCT {cols}len, w - start_x AS k FROM {source}) d JOIN {out}_{tag}n a ON {on} GROUP BY ALL)""")
        using = ", ".join([*by, "l", "k"])
        joins.append(f"LEFT JOIN (SELECT {cols}l, k, c AS {tag}_c, u AS {tag}_u FROM {out}_{tag}q) USING ({using})")
        joins.append(f"LEFT JOIN (SELECT {cols}t AS {tag}_t FROM {out}_{tag}t) USING ({', '.join(by)})" if by else f"CROSS JOIN (SELECT t AS {tag}_t FROM {out}_{tag}t)")
    seen = "(CASE WHEN b_t IS NULL THEN 0 ELSE 0.95::DOUBLE END)"
    special = f"(CASE WHEN s_t IS NULL THEN 0 ELSE {weight}::DOUBLE END)"

    def mixed(value) -> str:
        of = lambda tag: f"({value(tag)}) / (coalesce({tag}_t, 0) + 32::DOUBLE)"
        base = f"({seen} * {of('b')} + (1 - {seen}) * {of('g')})"
        return f"({special} * {of('s')} + (1 - {special}) * {base})" if keys else base

    p, z = mixed(lambda t: f"coalesce({t}_c, 0) + 0.5::DOUBLE"), mixed(lambda t: f"coalesce({t}_u, 0) + 0.5::DOUBLE * k")
    return ",\n".join(parts) + f""",
{out} AS (
  SELECT s.*, -log2({p}) + log2({z}) AS bits_len
  FROM (SELECT *, len AS l, w - start_x AS k FROM {source}) s {' '.join(joins)})"""


SCORED = f"{ABOVE},\n{label_ctes(2, True, 'rows_', 'lab')},\n{length_ctes('above', 'lab', 'scored')},\n{SIZES}"


def tile_ctes(scored: str, tile: int, out: str = "heat") -> str:
    """Tile means pixel by pixel."""
    return f"""{out}_px AS (SELECT image, y, unnest(range(start_x, start_x + len)) AS x, (bits_label + bits_len) / greatest(len, 1) AS per FROM {scored}),
{out} AS (SELECT image, y // {tile} AS gy, x // {tile} AS gx, avg(per) AS heat FROM {out}_px GROUP BY ALL)"""


TOKENS = f"""{RUNS},
tok AS (
  SELECT image, y, 2 * run_idx AS t, label AS sym, 0::BIGINT AS lo, 3::BIGINT AS hi FROM runs
  UNION ALL SELECT image, y, 2 * run_idx + 1, least(len, 64) + 3, 4, least(64, greatest(1, w - start_x)) + 3 FROM runs)"""


def kt_ctes(order: int) -> str:
    ctx = f"coalesce(list(sym) OVER (PARTITION BY image, y ORDER BY t ROWS BETWEEN {order} PRECEDING AND 1 PRECEDING), [])" if order else "CAST([] AS BIGINT[])"
    n = f"k{order}"
    return f"""{n}_x AS (SELECT *, {ctx} AS ctx FROM tok),
{n}_c AS (SELECT ctx, sym, count(*) AS c FROM {n}_x WHERE {TRAIN} GROUP BY ALL),
{n}_t AS (SELECT ctx, sum(c) AS n FROM {n}_c GROUP BY ALL),
{n}_r AS (SELECT r.ctx, r.lo, r.hi, sum(c) AS m FROM (SELECT DISTINCT ctx, lo, hi FROM {n}_x) r JOIN {n}_c a ON a.ctx = r.ctx AND a.sym BETWEEN r.lo AND r.hi GROUP BY ALL),
{n} AS (
  SELECT image, y, t, (coalesce(c, 0) + 0.5::DOUBLE) / (coalesce(n, 0) + 34::DOUBLE) AS {n}_p, (coalesce(m, 0) + 0.5::DOUBLE * (hi - lo + 1)) / (coalesce(n, 0) + 34::DOUBLE) AS {n}_z
  FROM {n}_x LEFT JOIN {n}_c USING (ctx, sym) LEFT JOIN {n}_t USING (ctx) LEFT JOIN {n}_r USING (ctx, lo, hi))"""


def kt_sql(weights: list[str], cost: str, more: str = "") -> str:
    n = len(weights)
    ctes = ",\n".join(kt_ctes(k) for k in range(n))
    joins = " ".join(f"JOIN k{k} USING (image, y, t)" for k in range(n))
    p, z = (" + ".join(f"{w} * k{k}_{c}" for k, w in enumerate(weights)) for c in "pz")
    cross = ", w" if more else ""
    return f"""WITH {TOKENS},
{ctes}{more},
mix AS (SELECT image, lo, greatest({p}, 1e-12) AS p, greatest({z}, 1e-12) AS z FROM (SELECT * FROM tok {joins}){cross})
SELECT image, round(sum(-log2(greatest({cost}, 1e-12))), 6) AS bits FROM mix GROUP BY image"""


def evidence_cte(orders: int) -> str:
    parts = []
    for k in range(orders):
        parts.append(f"""SELECT {k} AS k, sum(e - lgamma(n + 34) + lgamma(34)) AS log_evidence FROM (
    SELECT ctx, CAST(sum(c) AS DOUBLE) AS n, sum(lgamma(c + 0.5::DOUBLE) - lgamma(0.5::DOUBLE)) AS e FROM k{k}_c GROUP BY ctx)""")
    return "ev AS (" + "\n  UNION ALL ".join(parts) + ")"


EVIDENCE_W = """,
""" + evidence_cte(2) + """,
ex AS (SELECT k, exp(log_evidence - (SELECT max(log_evidence) FROM ev)) AS e FROM ev),
w AS (SELECT sum(CASE WHEN k = 0 THEN e END) / greatest(sum(e), 1e-12) AS w0, sum(CASE WHEN k = 1 THEN e END) / greatest(sum(e), 1e-12) AS w1 FROM ex)"""

BYTES = """bl AS (SELECT doc_id, encode(text) AS e FROM documents WHERE strlen(text) > 0),
bt AS (SELECT doc_id, unnest(range(0, octet_length(e))) AS pos, unnest(list_transform(range(0, octet_length(e)), lambda i: CAST('0x' || substr(hex(e), 2 * i + 1, 2) AS INTEGER))) AS b FROM bl),
byt AS (
  SELECT doc_id, pos, b, coalesce(lag(b, 1) OVER o, 0) AS b1, coalesce(lag(b, 2) OVER o, 0) AS b2 FROM bt WINDOW o AS (ORDER BY doc_id, pos)),
bc AS (SELECT b2, b1, b, count(*) AS c0 FROM byt WHERE doc_id % 5 <> 0 GROUP BY ALL),
bn AS (SELECT b2, b1, sum(c0) AS n FROM bc GROUP BY ALL),
be AS (
  SELECT doc_id, -log2((coalesce(c0, 0) + 0.5::DOUBLE) / (coalesce(n, 0) + 128::DOUBLE)) AS e
  FROM byt LEFT JOIN bc USING (b2, b1, b) LEFT JOIN bn USING (b2, b1))"""

RES = f"""{LI},
res AS (
  SELECT c.sample, c.t, c.y, c.x, p.label AS prev, c.label AS cur, CAST(p.label <> c.label AS INTEGER) AS c, CASE WHEN p.label <> c.label THEN c.label ELSE 0 END AS v
  FROM pl c JOIN pl p ON p.sample = c.sample AND p.t + 1 = c.t AND p.y = c.y AND p.x = c.x)"""


def change_tiles(stride: int) -> str:
    return f"""{RES},
flags AS (SELECT -log2((sum(c) + 1)::DOUBLE / (count(*) + 2)) AS bit1, -log2((count(*) - sum(c) + 1)::DOUBLE / (count(*) + 2)) AS bit0 FROM res),
hist AS (SELECT v, count(*) AS k FROM res WHERE c = 1 GROUP BY v),
vals AS (SELECT v, -log2((coalesce(k, 0) + 1)::DOUBLE / ((SELECT sum(k) FROM hist) + 256)) AS bv FROM (SELECT unnest(range(0, 256)) AS v) LEFT JOIN hist USING (v)),
grid_t AS (SELECT gy, gx FROM (SELECT unnest(range(0, (10 - 8) // {stride} + 1)) AS gy), (SELECT unnest(range(0, (max(x) + 1 - 8) // {stride} + 1)) AS gx FROM res)),
tile AS (
  SELECT sample, t, gy, gx, avg(c) AS changed_frac, sum(CASE WHEN c = 1 THEN bit1 + bv ELSE bit0 END) AS iid_bits
  FROM grid_t JOIN res ON y >= gy * {stride} AND y < gy * {stride} + 8 AND x >= gx * {stride} AND x < gx * {stride} + 8 LEFT JOIN vals USING (v) CROSS JOIN flags GROUP BY ALL)"""


LABELLED = f"""{change_tiles(4)},
lab AS (SELECT sample || '_' || t AS pair, gy * 100000 + gx AS tile, round(iid_bits, 6) AS score, CAST(changed_frac >= 0.5 AS INTEGER) AS label FROM tile)"""

RESULTS = """res AS (
  SELECT l_suppkey % 10 AS id, l_orderkey AS filename, CASE l_returnflag WHEN 'A' THEN 'lzma' WHEN 'N' THEN 'zstd' ELSE 'bz2' END AS codec,
    CAST(l_linenumber AS INTEGER) AS level, CAST(l_quantity AS BIGINT) AS bytes_out, l_partkey % 7 AS h, l_partkey % 5 AS w, l_extendedprice / 1000 AS bbp FROM lineitem)"""
SUMMARY = "count({0}) AS n, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.9), 6) AS p90, round(min({0}), 6) AS least, round(max({0}), 6) AS greatest"


def pairs_sql(delta: int) -> str:
    return f"""WITH {PX},
fr AS (SELECT DISTINCT image // 4 AS sample, CASE WHEN (image // 4) % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'img' || image AS stem, 2000 + image % 4 AS key, CAST(image % 4 AS VARCHAR) AS t FROM px),
nx AS (SELECT *, lead(stem, {delta}) OVER o AS cur, lead(t, {delta}) OVER o AS t_cur FROM fr WINDOW o AS (PARTITION BY sample, split ORDER BY key, stem))
SELECT sample || '__' || stem || '__' || cur AS pair_id, CAST(sample AS VARCHAR) AS sample, stem AS prev, cur, t AS t_prev, t_cur, split FROM nx WHERE cur IS NOT NULL"""


ORACLE_SQL: dict[str, str] = {
    "runs_rowwise": f"WITH {RUNS} SELECT image, y, run_idx, start_x, len, label FROM runs",
    "runs_decode_check": f"WITH {PX} SELECT image, count(*) AS n_pixels, CAST(0 AS BIGINT) AS n_wrong FROM px GROUP BY image",
    "tokens_typed": f"WITH {RUNS} SELECT image, y, 2 * run_idx AS t, label AS token, 0 AS token_type, CAST(0 AS BIGINT) AS rem_width FROM runs UNION ALL SELECT image, y, 2 * run_idx + 1, len, 1, w - start_x FROM runs",
    "label_dim": f"WITH {PX} SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM px)",
    "row_items_above": f"WITH {ABOVE} SELECT image, y, run_idx, label, above_label, above_rem, CAST(above_label = label AS INTEGER) AS above_same FROM rows_",
    "runs_scanline_v0": f"WITH {SCAN} SELECT image, 2 * count(*) + 4 AS n_tokens, '-1,' || max(h) || ',' || max(w) || ',' || string_agg(value || ',' || len, ',' ORDER BY run_idx) || ',-2' AS tokens, CAST(NULL AS VARCHAR) AS error FROM lines GROUP BY image",
    "token_offsets": f"WITH {SCAN}, n AS (SELECT image, 2 * count(*) + 4 AS token_len FROM lines GROUP BY image) SELECT image, token_len, CAST(coalesce(sum(token_len) OVER (ORDER BY image ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset FROM n",
    "stream_stats": f"WITH {SCAN}, n AS (SELECT image, 2 * count(*) + 4 AS n, max(h * w) AS area FROM lines GROUP BY image) SELECT count(*) AS num_masks, CAST(sum(area) AS BIGINT) AS total_pixels, CAST(sum(n) AS BIGINT) AS total_tokens, round(sum(n)::DOUBLE / sum(area), 6) AS mean_tokens_per_pixel, round(avg(n), 6) AS mean_token_len, round(avg((n - 4) / 2), 6) AS mean_runs_per_mask FROM n",
    "unified_tokens": f"WITH {TOKENS} SELECT image, y, t, sym, lo, hi FROM tok",
    "cache_manifest": f"WITH {RUNS}, {SIZES}, u AS (SELECT image, string_agg(label, '|' ORDER BY label) AS unique_vals FROM (SELECT DISTINCT image, label FROM px) GROUP BY image), n AS (SELECT image, count(*) AS total_runs FROM runs GROUP BY image) SELECT image, h, w, unique_vals, total_runs FROM sizes JOIN u USING (image) JOIN n USING (image)",
    "row_locate": f"WITH {PX}, rr AS (SELECT DISTINCT image, y FROM px), g AS (SELECT image, y, row_number() OVER (ORDER BY image, y) - 1 AS row_idx FROM rr) SELECT row_idx, image, y FROM g WHERE row_idx % 37 = 0",
    "row_locate_all": f"WITH {PX}, rr AS (SELECT DISTINCT image, y FROM px) SELECT row_number() OVER (ORDER BY image, y) - 1 AS row_idx, image, y FROM rr",
    "delta_left_hist": f"WITH {LI}, dl AS (SELECT t, (label - lag(label, 1, 0) OVER (PARTITION BY sample, t, y ORDER BY x) + 256) % 256 AS delta FROM pl) SELECT t, delta, count(*) AS n FROM dl GROUP BY ALL",
    "rle_stream_size": f"WITH {LI}, {run_ctes('pl', 'sample, t')} SELECT sample, t, CAST(sum(1 + greatest(1, ceil(len(bin(len)) / 7))) AS BIGINT) AS bytes FROM runs GROUP BY ALL",
    "packed_size": f"WITH {LI} SELECT sample, t, CAST((count(*) + 7) // 8 AS BIGINT) AS bytes, CAST(sum(CAST(label > 0 AS INTEGER)) AS BIGINT) AS ones FROM pl GROUP BY ALL",
    "context_windows_t16": """WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS label FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT user_id AS image, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x, label FROM events JOIN k USING (event_type)),
c AS (SELECT image, x, label, coalesce(list(label) OVER (PARTITION BY image ORDER BY x ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), []) AS l FROM e)
SELECT image, x, label, array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), 16 - len(l), -1), l), ',') AS context FROM c""",
    "boundary_pixels": f"WITH {LI}, bd AS (SELECT sample, t, y, x FROM (SELECT *, lag(label) OVER (PARTITION BY sample, t, y ORDER BY x) AS l, lag(label) OVER (PARTITION BY sample, t, x ORDER BY y) AS u FROM pl) WHERE l <> label OR u <> label), nr AS (SELECT DISTINCT sample, t, y + dy AS y, x + dx AS x FROM bd, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) SELECT sample, t, y, count(*) AS n FROM pl SEMI JOIN nr USING (sample, t, y, x) GROUP BY ALL",
    "ngram_image_bbp": f"""WITH {SCORED}, s AS (SELECT image, sum(bits_label) AS a, sum(bits_len) AS b FROM scored GROUP BY image)
SELECT image, h, w, round(a, 6) AS bits_label, round(b, 6) AS bits_len, round(a + b, 6) AS bits_total, round((a + b) / (h * w), 6) AS bbp, round(a / (h * w), 6) AS bbp_label, round(b / (h * w), 6) AS bbp_len, round(b / greatest(a + b, 1e-12), 6) AS len_frac FROM s JOIN sizes USING (image)""",
    "ngram_tile_heat": f"WITH {SCORED}, {tile_ctes('scored', 12)} SELECT image, gy, gx, round(heat, 6) AS heat FROM heat",
    "ngram_heat_stats": f"WITH {SCORED}, {tile_ctes('scored', 12)} SELECT image, {SUMMARY.format('heat')} FROM heat GROUP BY image",
    "kt_order0_bits": kt_sql(["1::DOUBLE"], "p"),
    "kt_order1_bits": kt_sql(["0::DOUBLE", "1::DOUBLE"], "p"),
    "kt_order2_bits": kt_sql(["0::DOUBLE", "0::DOUBLE", "1::DOUBLE"], "p"),
    "ktmix_uniform": kt_sql(["0.5::DOUBLE", "0.5::DOUBLE"], "p"),
    "ktmix_evidence_weights": kt_sql(["w0", "w1"], "p", EVIDENCE_W),
    "ktmix_type_renorm": kt_sql(["0.5::DOUBLE", "0.5::DOUBLE"], "CASE WHEN lo = 0 THEN p / z ELSE p END"),
    "ktmix_len_renorm": kt_sql(["0.5::DOUBLE", "0.5::DOUBLE"], "p / z"),
    "kt_log_evidence": f"WITH {TOKENS}, {kt_ctes(0)}, {kt_ctes(1)}, {kt_ctes(2)}, {evidence_cte(3)} SELECT k, round(log_evidence, 4) AS log_evidence FROM ev",
    "markov2_xent": f"WITH {BYTES} SELECT count(*) AS n_bytes, round(sum(e) / count(*), 6) AS bits_per_byte, round(sum(e) / 8, 2) AS est_bytes FROM be WHERE doc_id % 5 = 0",
    "markov2_per_doc": f"WITH {BYTES} SELECT doc_id, count(*) AS n_bytes, round(sum(e), 4) AS bits FROM be GROUP BY doc_id",
    "pairs_delta1": pairs_sql(1),
    "pairs_delta2": pairs_sql(2),
    "split_leakage": "SELECT CAST(0 AS BIGINT) AS n_leaking",
    "residual_pixels": f"WITH {RES} SELECT sample, t, y, x, prev, cur, v FROM res WHERE c = 1",
    "residual_reconstruct_diff": f"WITH {RES} SELECT sample, t, CAST(sum(c) AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_wrong FROM res GROUP BY ALL",
    "tile_changed_frac": f"WITH {change_tiles(8)} SELECT sample, t, gy, gx, round(changed_frac, 6) AS changed_frac FROM tile",
    "tile_iid_bits": f"WITH {change_tiles(8)} SELECT sample, t, gy, gx, round(iid_bits, 6) AS iid_bits FROM tile",
    "tile_iid_bits_overlap": f"WITH {change_tiles(4)} SELECT sample, t, gy, gx, round(iid_bits, 6) AS iid_bits FROM tile",
    "tile_scores": f"WITH {change_tiles(4)}, a AS (SELECT 10 * (max(x) + 1) AS area FROM res) SELECT sample, t, round(sum(iid_bits) / max(area), 6) AS bbp_heat, round(min(iid_bits), 6) AS heat_min, round(quantile_cont(iid_bits, 0.5), 6) AS heat_p50, round(quantile_cont(iid_bits, 0.9), 6) AS heat_p90, round(max(iid_bits), 6) AS heat_max FROM tile, a GROUP BY ALL",
    "tile_labels": f"WITH {LABELLED} SELECT pair, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM lab GROUP BY pair",
    "roc_auc": f"WITH {LABELLED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM lab), s AS (SELECT sum(CASE WHEN label = 1 THEN rk END) AS rs, sum(label) AS p, count(*) AS n FROM r) SELECT round((rs - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) AS auc, n FROM s",
    "pr_auc": f"WITH {LABELLED}, d AS (SELECT score, sum(label) AS pos, count(*) AS n FROM lab GROUP BY score), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM d) SELECT round(sum(pos * tp::DOUBLE / seen) / nullif(sum(pos), 0), 6) AS ap FROM c",
    "roc_auc_one_class": f"WITH {LABELLED} SELECT CAST(NULL AS DOUBLE) AS auc, count(*) AS n FROM lab",
    "hit_recall_at_k": f"WITH {LABELLED}, r AS (SELECT pair, label, row_number() OVER (PARTITION BY pair ORDER BY score DESC, tile DESC) AS r FROM lab), b AS (SELECT pair, sum(CASE WHEN r <= 5 THEN label ELSE 0 END) AS hits, sum(label) AS positives FROM r GROUP BY pair) SELECT round(avg(CAST(hits > 0 AS INTEGER)), 6) AS hit_at_k, round(sum(hits)::DOUBLE / greatest(sum(positives), 1), 6) AS recall_at_k, count(*) AS n_pairs FROM b",
    "tile_density_heat": f"WITH {RUNS}, {label_ctes(2, True, 'runs', 'lb0', 'true')}, lb1 AS (SELECT *, 0.0::DOUBLE AS bits_len FROM lb0), {SIZES}, {tile_ctes('lb1', 8)} SELECT image, gy, gx, round(heat, 6) AS heat FROM heat JOIN sizes USING (image) WHERE (gy + 1) * 8 <= h AND (gx + 1) * 8 <= w",
    "weighted_bbp": f"WITH {RESULTS} SELECT codec, level, round(8 * sum(bytes_out)::DOUBLE / greatest(sum(greatest(h * w, 1)), 1), 6) AS bbp_weighted, count(DISTINCT id) AS n_ids, count(DISTINCT (id, filename)) AS n_images FROM res GROUP BY ALL",
    "best_codecs": f"WITH {RESULTS} SELECT codec, level, round(8 * sum(bytes_out)::DOUBLE / greatest(sum(greatest(h * w, 1)), 1), 6) AS bbp_weighted FROM res GROUP BY ALL ORDER BY 8 * sum(bytes_out)::DOUBLE / greatest(sum(greatest(h * w, 1)), 1), codec, level LIMIT 5",
    "seq_codec_mean": f"WITH {RESULTS} SELECT id, codec, level, round(avg(bbp), 6) AS bbp FROM res WHERE codec IN ('lzma', 'zstd') GROUP BY ALL",
    "codec_level_pivot": f"WITH {RESULTS} SELECT id, codec, round(avg(bbp) FILTER (WHERE level = 1), 6) AS level_1, round(avg(bbp) FILTER (WHERE level = 3), 6) AS level_3, round(avg(bbp) FILTER (WHERE level = 6), 6) AS level_6 FROM res GROUP BY ALL",
    "run_summary": f"WITH {RESULTS} SELECT id, codec, {SUMMARY.format('bbp')} FROM res GROUP BY ALL",
    "topk_hard": f"WITH {RESULTS}, m AS (SELECT id, filename, max(bbp) AS bbp FROM res GROUP BY ALL) SELECT id, filename, round(bbp, 6) AS bbp FROM (SELECT * FROM m ORDER BY bbp DESC, id, filename LIMIT 20)",
    "topk_unique_facade": f"WITH {RESULTS}, m AS (SELECT id, filename, max(bbp) AS bbp FROM res GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bbp DESC, filename) AS r FROM m) SELECT id, filename, round(bbp, 6) AS bbp FROM r WHERE r = 1",
    "best_epoch": "WITH l AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS epoch, avg(o_totalprice) / 1e5 AS val_bbp FROM orders GROUP BY ALL) SELECT (SELECT epoch FROM l ORDER BY val_bbp, epoch LIMIT 1) AS best_epoch, round((SELECT min(val_bbp) FROM l), 6) AS best_bbp, (SELECT epoch FROM l ORDER BY val_bbp DESC, epoch DESC LIMIT 1) AS worst_epoch",
    "lm_cv_merge": "SELECT a.o_orderkey AS pair_id, round(a.o_totalprice / 1000, 6) AS bits_c, round(b.o_totalprice / 1000, 6) AS bits_v, round(a.o_totalprice / 1000 + b.o_totalprice / 1000, 6) AS bits_sum FROM orders a JOIN orders b USING (o_orderkey) WHERE a.o_orderkey % 3 = 2",
    "lm_cv_merge_all": "SELECT a.o_orderkey AS pair_id, round(a.o_totalprice / 1000, 6) AS bits_c, round(b.o_totalprice / 1000, 6) AS bits_v, round(a.o_totalprice / 1000 + b.o_totalprice / 1000, 6) AS bits_sum FROM orders a JOIN orders b USING (o_orderkey)",
    "hybrid_bbp": """WITH s AS (SELECT l_orderkey AS pair_id, l_returnflag, l_linenumber AS place, max(l_extendedprice) AS bits FROM lineitem GROUP BY ALL),
a AS (SELECT pair_id, arg_max(bits, place) AS bits_c FROM s WHERE l_returnflag = 'A' GROUP BY pair_id), n AS (SELECT pair_id, arg_max(bits, place) AS bits_v FROM s WHERE l_returnflag = 'N' GROUP BY pair_id)
SELECT o_orderkey AS pair_id, round(o_totalprice / 1000, 6) AS bbp_heat, round(bits_c, 6) AS bits_c, round(bits_v, 6) AS bits_v, round((bits_c + bits_v) / 1e4, 6) AS bbp_hybrid, round(coalesce((bits_c + bits_v) / 1e4, o_totalprice / 1000), 6) AS bbp
FROM orders LEFT JOIN a ON a.pair_id = o_orderkey LEFT JOIN n ON n.pair_id = o_orderkey""",
    "metrics_merge": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 6) END AS auc, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS method FROM orders",
    "metrics_dedupe_last": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "metrics_parse_tau_k": "SELECT p_partkey, 'iid_tau0.' || p_size % 10 || CASE WHEN p_partkey % 3 > 0 THEN '_k' || p_size ELSE '' END AS method, CASE WHEN p_partkey % 3 > 0 THEN 'iid' END AS base, CASE WHEN p_partkey % 3 > 0 THEN CAST('0.' || p_size % 10 AS DOUBLE) END AS tau, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS k FROM part",
    "name_parse": "SELECT p_partkey, 'c' || p_partkey % 9 AS city, CAST(nullif(p_partkey % 4, 0) AS INTEGER) AS seq, CAST(nullif(p_partkey, 0) AS INTEGER) AS frame, 'gtFine_labelIds' AS kind, CAST(p_partkey % 13 AS INTEGER) AS gy, CAST(p_partkey % 17 AS INTEGER) AS gx, CAST(1990 + p_partkey % 40 AS INTEGER) AS y1, CAST(2000 + p_partkey % 30 AS INTEGER) AS y2, CAST(2000 + p_partkey % 30 AS INTEGER) AS last_year FROM part",
    "image_resolution": "WITH f AS (SELECT o_custkey AS stem, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) AS priority, 'images/' || o_orderkey AS path FROM orders), b AS (SELECT stem, path, row_number() OVER (PARTITION BY stem ORDER BY priority, path) AS r FROM f WHERE priority > 0) SELECT c_custkey AS stem, path, CASE WHEN path IS NULL THEN 'missing_image' ELSE 'ok' END AS status FROM customer LEFT JOIN (SELECT * FROM b WHERE r = 1) ON stem = c_custkey",
    "local_normalise": f"WITH {RESULTS}, m AS (SELECT id, filename, max(bbp) AS bbp FROM res GROUP BY ALL), e AS (SELECT id, quantile_cont(bbp, 0.05) AS lo, quantile_cont(bbp, 0.95) AS hi FROM m GROUP BY id) SELECT id, filename, round(bbp, 6) AS bbp, round(CASE WHEN hi - lo <= 1e-12 THEN 0 ELSE greatest(0, least(1, (bbp - lo) / (hi - lo))) END, 6) AS norm FROM m JOIN e USING (id)",
    "cdf_quantised": f"""WITH {PX}, b AS (SELECT lag(label, 1, -1) OVER (PARTITION BY image ORDER BY y, x) AS before, label FROM px), c AS (SELECT before, label, count(*) AS c FROM b GROUP BY ALL),
a AS (SELECT before, sym, coalesce(c, 0) + 0.5::DOUBLE AS p FROM (SELECT * FROM (SELECT unnest(range(-1, 4)) AS before), (SELECT unnest(range(0, 4)) AS sym)) LEFT JOIN (SELECT before, label AS sym, c FROM c) USING (before, sym)),
s AS (SELECT *, p / sum(p) OVER (PARTITION BY before) * (65536 - 4) AS share FROM a), f AS (SELECT *, floor(share) AS base FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY before ORDER BY share - base DESC, sym) AS rk, 65536 - 4 - sum(base) OVER (PARTITION BY before) AS rest FROM f),
q AS (SELECT before, sym, CAST(base + 1 + CAST(rk <= rest AS INTEGER) AS BIGINT) AS freq FROM r)
SELECT before, sym, freq, CAST(sum(freq) OVER (PARTITION BY before ORDER BY sym) - freq AS BIGINT) AS cum FROM q""",
}
for _n in (1, 2, 3):
    ORACLE_SQL[f"ngram_label_bits_o{_n}"] = f"WITH {RUNS}, {label_ctes(_n, True)} SELECT image, count(*) AS n_runs, round(sum(bits_label), 6) AS bits FROM lb_bits GROUP BY image"
ORACLE_SQL["ngram_label_bits_o2_carry"] = f"WITH {RUNS}, {label_ctes(2, False)} SELECT image, count(*) AS n_runs, round(sum(bits_label), 6) AS bits FROM lb_bits GROUP BY image"
for _m in LEN_KEYS:
    ORACLE_SQL[f"len_bits_{_m}"] = f"WITH {ABOVE}, {length_ctes(_m)} SELECT image, round(sum(bits_len), 6) AS bits FROM len_bits GROUP BY image"
