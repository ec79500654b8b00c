"""Further registered queries, each beside its DuckDB SQL, which is written from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import codecs, manifests, reports, run_codec, runs, streams
from ..sources import views
from . import catalogue
from .catalogue import IMAGE, KEY, image_runs, pixels, sizes, six
from .sql import ABOVE, LI, PX, RUNS, SCAN, SIZES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# --- streams and row caches

_LI_RUNS = f"""{LI}, pb AS (SELECT *, lag(label) OVER (PARTITION BY sample, t, y ORDER BY x) AS before, max(x + 1) OVER (PARTITION BY sample, t, y) AS w FROM pl),
lr AS (SELECT sample, t, y, x AS start_x, coalesce(lead(x) OVER r, w) - x AS len, label FROM pb WHERE before IS NULL OR before <> label WINDOW r AS (PARTITION BY sample, t, y ORDER BY x))"""


@query(f"WITH {_LI_RUNS} SELECT sample, t, string_agg(printf('%02X', label) || CASE WHEN len < 128 THEN printf('%02X', len) ELSE printf('%02X', 128 + len % 128) || printf('%02X', len // 128) END, '' ORDER BY y, start_x) AS data, count(*) AS n_runs FROM lr GROUP BY ALL")
def rle_stream_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = runs.runs(views.lineitem_pixels(spark, d), KEY)
    return streams.run_bytes(rows, KEY).join(rows.groupBy(*KEY).agg(F.count("*").alias("n_runs")), KEY).select(*KEY, F.hex("data").alias("data"), "n_runs")


@query(f"WITH {LI}, f AS (SELECT *, y * max(x + 1) OVER (PARTITION BY sample, t) + x AS p FROM pl), b AS (SELECT sample, t, p // 8 AS i, sum(CASE WHEN label > 0 THEN 1 << CAST(p % 8 AS INTEGER) ELSE 0 END) AS b FROM f GROUP BY ALL) SELECT sample, t, string_agg(printf('%02X', CAST(b AS BIGINT)), '' ORDER BY i) AS data FROM b GROUP BY ALL")
def packed_bits(spark, d):
    return streams.packed(views.lineitem_pixels(spark, d), KEY, F.col("label") > 0).select(*KEY, F.hex("data").alias("data"))


def _cache(spark, d) -> DataFrame:
    px = pixels(spark, d)
    rows = runs.runs(px, IMAGE)
    return streams.row_cache(rows, runs.above(rows, px, IMAGE), IMAGE)


@query(f"WITH {ABOVE}, c AS (SELECT image, y, count(*) AS n_runs, string_agg(label, ',' ORDER BY run_idx) AS labels, string_agg(len, ',' ORDER BY run_idx) AS lengths, string_agg(CASE WHEN y = 0 THEN 65535 ELSE above_label END, ',' ORDER BY run_idx) AS above FROM rows_ GROUP BY image, y) SELECT image, y, CAST(coalesce(sum(n_runs) OVER (PARTITION BY image ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr, n_runs, labels, lengths, above FROM c")
def row_cache(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _cache(spark, d).select("image", "y", "row_ptr", "n_runs", *map(text, ("labels", "lengths", "above")))


@query(f"WITH {RUNS} SELECT image, y, run_idx, start_x, len, label FROM runs")
def row_cache_decoded(spark, d):
    return streams.cached_runs(_cache(spark, d), IMAGE)


@query(f"WITH {RUNS}, t AS (SELECT image, y, 2 * run_idx AS t, label AS token, 0 AS ty, 0 AS rem FROM runs UNION ALL SELECT image, y, 2 * run_idx + 1, len, 1, w - start_x FROM runs) SELECT image, y, '9,' || string_agg(token, ',' ORDER BY t) AS tokens, '-1,' || string_agg(ty, ',' ORDER BY t) AS types, '0,' || string_agg(rem, ',' ORDER BY t) AS room, '-100,' || string_agg(token, ',' ORDER BY t) AS targets FROM t GROUP BY ALL")
def bos_rows(spark, d):
    made = streams.shifted_tokens(runs.typed_tokens(image_runs(spark, d), IMAGE), IMAGE, 9)
    return made.select("image", "y", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("tokens", "types", "room", "targets")))


@query(f"WITH {PX} SELECT image, y, x, CAST(label > 1 AS BIGINT) AS label FROM px")
def contract_decoded(spark, d):
    tokens = runs.contract_tokens(runs.scanline(pixels(spark, d), IMAGE, (F.col("label") > 1).cast("int")), IMAGE)
    return streams.decode_contract(tokens, IMAGE)


@query(f"WITH {SCAN} SELECT image, count(*) AS n_runs, count(*) FILTER (WHERE len > 16) AS too_long, max(len) AS longest FROM lines GROUP BY image")
def run_length_guard(spark, d):
    lines = runs.scanline(pixels(spark, d), IMAGE, (F.col("label") > 1).cast("int"))
    return lines.groupBy("image").agg(F.count("*").alias("n_runs"), F.count_if(F.col("len") > 16).alias("too_long"), F.max("len").alias("longest"))


@query(f"WITH {RUNS}, r AS (SELECT image, y, list(label ORDER BY run_idx) AS v FROM runs GROUP BY ALL), b AS (SELECT *, y // 4 AS batch, y % 4 AS place, max(len(v)) OVER (PARTITION BY image, y // 4) AS m FROM r) SELECT image, batch, place, array_to_string(list_concat(v, list_transform(range(m - len(v)), lambda i: -1)), ',') AS values, len(v) AS n FROM b")
def padded_batches(spark, d):
    rows = image_runs(spark, d).groupBy("image", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "label"))), lambda r: r["label"]).alias("v"))
    made = streams.batches(rows, IMAGE, ["y"], "v", 4, -1)
    total = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("image", "batch", "place", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("values"), total.alias("n"))


@query("SELECT image, row_number() OVER (ORDER BY h, image) AS place FROM (SELECT DISTINCT vec_id // 16 AS image, md5('10:' || (vec_id // 16)) AS h FROM embeddings)")
def shuffled_files(spark, d):
    from ..operators.ranges import numbered

    files = pixels(spark, d).select("image").distinct().withColumn("h", streams.file_order("image", 7, 3))
    first = F.conv(F.substring("h", 1, 12), 16, 10).cast("long")
    return numbered(files.withColumn("k", first), "k", "place", ("h", "image")).select("image", "place")


@query(f"WITH {PX} SELECT image || '__gy' || (y // 8) || '__gx' || (x // 8) || '.png' AS name, count(*) AS n_pixels, CAST(sum(label) AS BIGINT) AS total, max(y % 8) AS last_y, max(x % 8) AS last_x FROM px GROUP BY image, y // 8, x // 8 HAVING count(*) = 64")
def tile_dataset(spark, d):
    tiled = runs.tiles(pixels(spark, d).join(sizes(spark, d), "image"), 8, 8, F.col("h"), F.col("w"))
    return streams.tile_images(tiled, "image", 8).groupBy("name").agg(F.count("*").alias("n_pixels"), F.sum("label").alias("total"), F.max("ty").alias("last_y"), F.max("tx").alias("last_x"))


@query(f"WITH {PX} SELECT image, y, x, CAST(sum(label) OVER (PARTITION BY image, x ORDER BY y, yy) AS BIGINT) AS total FROM (SELECT image, y, x, 0 AS yy, CAST(sum(label) OVER (PARTITION BY image, y ORDER BY x) AS BIGINT) AS label FROM px)")
def integral_image(spark, d):
    return runs.integral(pixels(spark, d), IMAGE).select("image", "y", "x", "total")


@query(f"WITH {PX}, w AS (SELECT image, y, x, sum(label) OVER (PARTITION BY image, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM px), v AS (SELECT image, y, x, CAST(sum(s) OVER (PARTITION BY image, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS sum FROM w) SELECT image, y, x, sum FROM v WHERE y >= 2 AND x >= 4")
def rectangle_sums(spark, d):
    return runs.rectangle(runs.integral(pixels(spark, d), IMAGE), IMAGE, 3, 5)


@query("SELECT vec_id, 1 + vec_id % 40 AS room, vec_id % 12 AS target, round(CASE WHEN vec_id % 12 < 1 THEN 0 ELSE -log2(exp(CAST(embedding[least(vec_id % 12, 1 + vec_id % 40)] AS DOUBLE)) / list_sum(list_transform(embedding[1:1 + vec_id % 40], lambda x: exp(CAST(x AS DOUBLE))))) END, 6) + 0 AS bits FROM embeddings")
def length_nll(spark, d):
    rows = views.read(spark, d, "embeddings").select("vec_id", (1 + F.col("vec_id") % 40).alias("room"), (F.col("vec_id") % 12).alias("target"), F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    # a target beyond the room is the last length of it
    return rows.select("vec_id", "room", "target", F.round(streams.truncated_nll(F.col("s"), F.col("room"), F.least("target", "room")), 6).alias("bits"))


# --- manifests, splits, filters

_PATHS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'images/' WHEN 1 THEN 'warped/' WHEN 2 THEN 'Masks/' ELSE 'a/' END || CASE p_partkey % 7 WHEN 0 THEN 'aug_' WHEN 1 THEN 'x_overlay' ELSE 'p' END || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.tif' ELSE '.jpg' END AS path FROM part"


def _paths(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda m, names, other: F.element_at(F.array(*map(F.lit, [*names, *[other] * (m - len(names))])), (k % m + 1).cast("int"))
    path = F.concat(pick(5, ["images/", "warped/", "Masks/"], "a/"), pick(7, ["aug_", "x_overlay"], "p"), k.cast("string"), pick(4, [".PNG", ".jpeg", ".tif"], ".jpg"))
    return views.read(spark, d, "part").select(k.alias("id"), path.alias("path"))


_CANDIDATE = "regexp_matches(lower(path), '\\.(png|jpg|jpeg)$') AND NOT regexp_matches(lower(path), 'mask|label|overlay|_diff') AND NOT starts_with(lower(regexp_extract(path, '[^/]*$')), 'aug_')"


@query(f"SELECT id, path FROM ({_PATHS}) WHERE {_CANDIDATE}")
def candidate_images(spark, d):
    return _paths(spark, d).filter(manifests.is_candidate(F.col("path")))


@query(f"SELECT id, path FROM ({_PATHS}) WHERE id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1) ORDER BY path LIMIT 25")
def first_of_kept(spark, d):
    ids = views.read(spark, d, "customer").filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"))
    return manifests.first_files(manifests.kept_ids(_paths(spark, d), ids, "id"), "path", 25)


@query("SELECT o_custkey AS scene, o_orderkey AS frame FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders) WHERE n % 3 = 0 AND n < 12")
def scene_stride_cap(spark, d):
    return manifests.every_nth(views.read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3, 4).select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("frame"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def skip_existing(spark, d):
    done = views.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return manifests.pending(views.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), done, "id")


@query("SELECT CASE WHEN p.p_partkey IS NULL THEN 'skipped_missing_image' WHEN l_quantity > 45 THEN 'failed' ELSE 'processed' END AS status, l_linenumber AS line, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0) p ON l_partkey = p_partkey GROUP BY ALL")
def status_counts(spark, d):
    found = views.read(spark, d, "part").filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("found"))
    rows = views.read(spark, d, "lineitem").join(found, "l_partkey", "left")
    state = manifests.status(F.coalesce("found", F.lit(False)), F.when(F.col("l_quantity") > 45, "too many"))
    return rows.groupBy(state.alias("status"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"))


_SPLIT = "SELECT o_orderkey, o_custkey AS sample, CASE WHEN o_orderkey % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM orders"


def _leaky(spark, d) -> DataFrame:
    return views.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("sample"), F.when(F.col("o_orderkey") % 4 == 0, "val").otherwise("train").alias("split"))


@query(f"WITH s AS ({_SPLIT}) SELECT sample FROM s WHERE split = 'train' INTERSECT SELECT sample FROM s WHERE split = 'val'")
def leaking_samples(spark, d):
    from ..operators import change

    return change.leaking(_leaky(spark, d))


@query(f"WITH s AS ({_SPLIT}) SELECT o_orderkey, sample FROM s WHERE split = 'train' AND sample NOT IN (SELECT sample FROM s WHERE split = 'val' AND sample IS NOT NULL)")
def train_without_val(spark, d):
    rows = _leaky(spark, d)
    return manifests.without_overlap(rows.filter("split = 'train'"), rows.filter("split = 'val'"), "sample").select("o_orderkey", "sample")


@query("""WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT k, n, n * 0.25::DOUBLE AS e FROM n), b AS (SELECT k, n, CAST(CASE WHEN e - floor(e) = 0.5 AND floor(e) % 2 = 0 THEN floor(e) ELSE floor(e + 0.5) END AS BIGINT) AS b FROM r)
SELECT k, n, CASE WHEN n <= 1 THEN 0 ELSE least(greatest(b, 1), n - 1) END AS library, CASE WHEN n <= 1 THEN 0 ELSE greatest(b, 1) END AS ngram, CASE WHEN n <= 1 THEN 0 ELSE greatest(b, 1) END AS varorder, least(greatest(b, 1), n) AS frames FROM b""")
def split_sizes(spark, d):
    rows = views.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return rows.select("k", "n", *(manifests.val_size(F.col("n"), 0.25, v).alias(v) for v in ("library", "ngram", "varorder", "frames")))


@query("SELECT c_custkey AS id FROM customer ORDER BY md5('5:' || c_custkey), c_custkey LIMIT 40")
def seeded_sample(spark, d):
    return manifests.seeded_sample(views.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", 5, 40)


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A'")
def distinct_ids(spark, d):
    return views.read(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_suppkey").alias("id")).distinct()


@query("SELECT l_orderkey AS id, l_returnflag AS part FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag = 'N'")
def train_and_val_rows(spark, d):
    rows = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("part"))
    return reports.union_all([rows.filter("part = 'A'"), rows.filter("part = 'N'")])


@query("SELECT c_custkey, c_nationkey, r.best FROM customer CROSS JOIN (SELECT o_orderkey AS best FROM orders ORDER BY o_orderkey LIMIT 1) r")
def first_metrics_row(spark, d):
    rows = views.read(spark, d, "customer").select("c_custkey", "c_nationkey")
    metrics = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("best"), F.col("o_custkey").alias("c_custkey"))
    return manifests.with_first_row(rows, metrics, "best")


@query("""WITH t AS (SELECT l_orderkey % 20 AS pair, l_partkey % 6 AS gy, l_suppkey % 5 AS gx, l_orderkey * 10 + l_linenumber AS place, CAST(l_quantity AS DOUBLE) AS heat FROM lineitem),
m AS (SELECT i AS pair, 3 + i % 3 AS gh, 2 + i % 4 AS gw FROM range(20) r(i)), o AS (SELECT pair, gy, gx, arg_max(heat, place) AS heat FROM t GROUP BY ALL)
SELECT m.pair, y.gy, x.gx, coalesce(o.heat, 0) AS heat FROM m, range(6) y(gy), range(6) x(gx) LEFT JOIN o ON o.pair = m.pair AND o.gy = y.gy AND o.gx = x.gx WHERE y.gy < gh AND x.gx < gw""")
def tile_heat_grid(spark, d):
    items = views.read(spark, d, "lineitem")
    rows = items.select((F.col("l_orderkey") % 20).alias("pair"), (F.col("l_partkey") % 6).alias("gy"), (F.col("l_suppkey") % 5).alias("gx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_quantity").cast("double").alias("heat"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.filter("heat is not null and place is not null")  # arg_max passes over both
    meta = spark.range(20).select(F.col("id").alias("pair"), (3 + F.col("id") % 3).alias("gh"), (2 + F.col("id") % 4).alias("gw"))
    return manifests.heat_grid(rows, meta, ["pair"], "place", ("file", "row"))  # places repeat: the first row in the table's order


@query("SELECT n_nationkey AS id, s AS stream, c AS codec, l AS level FROM nation, (SELECT unnest(['raw', 'rle']) AS s), (SELECT unnest(['zlib', 'zstd']) AS c), (SELECT unnest([1, 3, 6, 9]) AS l)")
def settings_grid(spark, d):
    return manifests.settings_grid(views.read(spark, d, "nation").select(F.col("n_nationkey").alias("id")), ["raw", "rle"], ["zlib", "zstd"], [1, 3, 6, 9])


# --- scalars, summaries, reports


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN log2(CAST(l_discount AS DOUBLE)) ELSE 0 END, 6) AS log2, l_discount <= 0 AS is_inf, l_partkey * 37 % 255 AS r, l_partkey * 67 % 255 AS g, l_partkey * 97 % 255 AS b FROM lineitem""")
def scalar_log2_palette(spark, d):
    rows = views.read(spark, d, "lineitem")
    log2 = scalars.log2_safe(F.col("l_discount").cast("double"))
    infinite = log2 == float("inf")
    colours = scalars.palette(F.col("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.when(infinite, 0.0).otherwise(log2), 6).alias("log2"), infinite.alias("is_inf"), *(colours[i].alias(c) for i, c in enumerate("rgb")))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def class_argmax(spark, d):
    return views.read(spark, d, "embeddings").select("vec_id", scalars.argmax(F.col("embedding")).alias("best"))


@query("SELECT p_partkey, regexp_replace(p, '.*/', '') AS file, regexp_replace(regexp_replace(p, '.*/', ''), '\\.[^.]*$', '') AS stem, 'data/' || p_brand AS parent, sha256(p) AS digest FROM (SELECT *, 'data/' || p_brand || '/' || p_partkey || '.leftImg8bit.png' AS p FROM part)")
def path_parts(spark, d):
    rows = views.read(spark, d, "part").select("p_partkey", F.concat(F.lit("data/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".leftImg8bit.png")).alias("p"))
    return rows.select("p_partkey", F.substring_index("p", "/", -1).alias("file"), scalars.stem(F.col("p")).alias("stem"), F.substring_index("p", "/", 2).alias("parent"), F.sha2("p", 256).alias("digest"))


@query("SELECT p_partkey, CAST(printf('%09d', p_partkey * 7) AS BIGINT) AS frame, 'c' || (p_partkey % 3) AS camera FROM part ORDER BY frame")
def frame_order(spark, d):
    rows = views.read(spark, d, "part").select("p_partkey", F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string"), F.lit("_"), F.lpad((F.col("p_partkey") * 7).cast("string"), 9, "0"), F.lit(".png")).alias("name"))
    return rows.select("p_partkey", scalars.frame_number(F.col("name")).alias("frame"), F.substring_index("name", "_", 1).alias("camera")).orderBy("frame")


@query(r"SELECT p_partkey, array_to_string([regexp_replace(s, '_warped$', '_overlay'), regexp_replace(s, '_warped$', '_diff'), s], ',') AS stems FROM (SELECT p_partkey, 'm' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_warped' ELSE '' END AS s FROM part)")
def background_stems(spark, d):
    stem = F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_warped").otherwise(""))
    return views.read(spark, d, "part").select("p_partkey", F.array_join(manifests.background_stem(stem), ",").alias("stems"))


@query(f"WITH {PX} SELECT max(x) + 1 AS max_width, max(label) AS max_label, count(DISTINCT label) AS n_labels FROM px")
def dataset_extent(spark, d):
    return pixels(spark, d).agg((F.max("x") + 1).alias("max_width"), F.max("label").alias("max_label"), F.countDistinct("label").alias("n_labels"))


@query(f"WITH {PX} SELECT label, count(*) AS n FROM px GROUP BY label")
def label_histogram(spark, d):
    return pixels(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {PX}, {SIZES} SELECT min(h) AS min_h, max(h) AS max_h, min(w) AS min_w, max(w) AS max_w, count(*) AS n FROM sizes")
def image_size_range(spark, d):
    return sizes(spark, d).agg(F.min("h").alias("min_h"), F.max("h").alias("max_h"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.count("*").alias("n"))


@query("SELECT l_linenumber AS epoch, round(sum(CAST(l_extendedprice AS DOUBLE)) / sum(CAST(l_quantity AS DOUBLE)), 6) AS train_bbp FROM lineitem GROUP BY ALL")
def training_bbp(spark, d):
    total = lambda c: F.sum(F.col(c).cast("double"))
    return views.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg((total("l_extendedprice") / total("l_quantity")).alias("train_bbp")).withColumns(six("train_bbp"))


@query("SELECT l_suppkey % 10 AS id, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90 FROM (SELECT l_suppkey, CASE WHEN l_tax > 0 THEN CAST(l_extendedprice AS DOUBLE) / l_tax ELSE 'inf'::DOUBLE END AS x FROM lineitem) WHERE isfinite(x) GROUP BY ALL")
def finite_summary(spark, d):
    x = F.when(F.col("l_tax") > 0, F.try_divide(F.col("l_extendedprice").cast("double"), F.col("l_tax").cast("double"))).otherwise(float("inf"))
    rows = views.read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("id"), x.alias("x")).filter(~F.isnan("x") & (F.abs("x") < float("inf")))
    return reports.summary(rows, ["id"], "x").select("id", "n", "mean", "p50", "p90").withColumns(six("mean", "p50", "p90"))


@query("WITH e AS (SELECT month(o_orderdate) AS epoch, avg(CAST(o_totalprice AS DOUBLE)) / 1e5 AS v FROM orders GROUP BY ALL) SELECT 7 AS epoch, round(max(v) FILTER (WHERE epoch = 7), 6) AS val_bbp FROM e")
def chosen_epoch(spark, d):
    log = views.read(spark, d, "orders").groupBy(F.month("o_orderdate").alias("epoch")).agg((F.avg(F.col("o_totalprice").cast("double")) / 1e5).alias("v"))
    return log.filter("epoch = 7").agg(F.max("epoch").alias("epoch"), F.max("v").alias("val_bbp")).withColumns(six("val_bbp"))


_RUNS_SUMMARY = "SELECT l_suppkey AS run, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) AS med, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9) AS p90 FROM lineitem GROUP BY ALL"


@query(f"WITH r AS ({_RUNS_SUMMARY}) (SELECT 'median' AS by_, run, round(med, 6) AS value FROM r ORDER BY med, run LIMIT 10) UNION ALL (SELECT 'p90', run, round(p90, 6) FROM r ORDER BY p90, run LIMIT 10)")
def best_runs(spark, d):
    got = reports.summary(views.read(spark, d, "lineitem").withColumnRenamed("l_suppkey", "run"), ["run"], "l_extendedprice")
    best = lambda c, name: got.orderBy(c, "run").limit(10).select(F.lit(name).alias("by_"), "run", F.round(c, 6).alias("value"))
    return best("p50", "median").unionByName(best("p90", "p90"))


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, round((c_acctbal - lo) / (hi - lo), 6) AS norm FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) QUALIFY rank <= 30")
def topk_index(spark, d):
    """The rank and the value between the table's least and greatest, of the 30 greatest values."""
    rows = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    ends = rows.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    top = rows.orderBy(F.desc("c_acctbal"), "id").limit(30).crossJoin(F.broadcast(ends))  # one row
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "id"))  # 30 rows
    return top.select("id", rank.cast("long").alias("rank"), F.round(F.try_divide(F.col("c_acctbal") - F.col("lo"), F.col("hi") - F.col("lo")), 6).alias("norm"))


_METRICS = "SELECT o_custkey % 50 AS run, CASE o_orderkey % 3 WHEN 0 THEN 'iid_tau0.10_k5' WHEN 1 THEN 'iid_tau0.30_k5' ELSE 'iid' END AS method, o_orderkey AS place, CAST(o_totalprice AS DOUBLE) AS auc FROM orders"


@query(f"WITH m AS ({_METRICS}), l AS (SELECT run, method, arg_max(auc, place) AS auc FROM m WHERE method LIKE '%tau%' GROUP BY ALL) SELECT run, round(max(auc) FILTER (WHERE method = 'iid_tau0.10_k5'), 6) AS tau_0_1, round(max(auc) FILTER (WHERE method = 'iid_tau0.30_k5'), 6) AS tau_0_3 FROM l GROUP BY run")
def metrics_summary(spark, d):
    rows = views.read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("run"), F.element_at(F.array(*map(F.lit, ("iid_tau0.10_k5", "iid_tau0.30_k5", "iid"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("method"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").cast("double").alias("auc"))
    parsed = rows.withColumns(scalars.tau_and_k(F.col("method"))).filter("tau is not null")
    last = reports.last_row(parsed, ["run", "method"], "place")
    wide = last.groupBy("run").pivot("tau", [0.1, 0.3]).agg(F.first("auc"))
    return wide.select("run", F.round(F.col("`0.1`"), 6).alias("tau_0_1"), F.round(F.col("`0.3`"), 6).alias("tau_0_3"))


@query("WITH c AS (SELECT l_returnflag AS codec, l_linenumber AS level, avg(CAST(l_quantity AS DOUBLE)) AS bbp FROM lineitem GROUP BY ALL), b AS (SELECT * FROM c ORDER BY bbp, codec, level LIMIT 1) SELECT l_linestatus AS name, round(avg(CAST(l_quantity AS DOUBLE)) / max(b.bbp), 6) AS ratio, round(100 * (avg(CAST(l_quantity AS DOUBLE)) - max(b.bbp)) / max(b.bbp), 6) AS delta_pct, max(b.codec) AS best_codec, max(b.level) AS best_level FROM lineitem, b GROUP BY ALL")
def lm_against_classic(spark, d):
    items = views.read(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    classic = items.groupBy(F.col("l_returnflag").alias("codec"), F.col("l_linenumber").alias("level")).agg(F.avg("q").alias("bbp"))
    got = manifests.against_best(items.groupBy(F.col("l_linestatus").alias("name")).agg(F.avg("q").alias("bbp")), classic)
    return got.select("name", "ratio", "delta_pct", "best_codec", "best_level").withColumns(six("ratio", "delta_pct"))


@query("""WITH r AS (SELECT CASE l_linestatus WHEN 'O' THEN 'online' ELSE 'pretrained' END AS mode, l_returnflag AS split, l_partkey % 900 + 1 AS payload, l_suppkey % 40 AS header, CAST((l_partkey % 900 + 1) * 8 AS DOUBLE) * (0.9::DOUBLE + (l_orderkey % 10) / 100.0::DOUBLE) AS ideal FROM lineitem)
SELECT mode, split, count(*) AS n, round(quantile_cont(100 * (8 * payload / ideal - 1), 0.5), 6) AS overhead_p50, round(quantile_cont(100 * (8 * payload / ideal - 1), 0.9), 6) AS overhead_p90, round(quantile_cont(100.0::DOUBLE * header / (payload + header), 0.5), 6) AS header_p50, CAST(sum(8 * (payload + header)) AS BIGINT) AS bits_file FROM r GROUP BY ALL""")
def coder_matrix(spark, d):
    k = F.col("l_partkey") % 900 + 1
    rows = views.read(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "online").otherwise("pretrained").alias("mode"), F.col("l_returnflag").alias("split"), k.alias("payload_bytes"), (F.col("l_suppkey") % 40).alias("header_bytes"), ((k * 8).cast("double") * (F.lit(0.9) + (F.col("l_orderkey") % 10) / F.lit(100.0))).alias("ideal_bits"))
    got = manifests.coder_overheads(rows)
    p = lambda c, q: F.percentile(F.col(c).cast("double"), F.lit(q))
    return got.groupBy("mode", "split").agg(F.count("*").alias("n"), p("overhead_pct", 0.5).alias("overhead_p50"), p("overhead_pct", 0.9).alias("overhead_p90"), p("header_pct", 0.5).alias("header_p50"), F.sum("bits_file").alias("bits_file")).withColumns(six("overhead_p50", "overhead_p90", "header_p50"))


@query("SELECT l_suppkey % 10 AS id, l_linenumber AS level, count(*) AS n, CAST(sum(l_partkey % 500) AS BIGINT) AS bytes, round(avg(l_partkey % 500), 6) AS mean, round(quantile_cont(CAST(l_partkey % 500 AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(l_partkey % 500 AS DOUBLE), 0.9), 6) AS p90 FROM lineitem GROUP BY ALL")
def tile_codec_stats(spark, d):
    rows = views.read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("id"), F.col("l_linenumber").alias("level"), (F.col("l_partkey") % 500).alias("bytes"))
    got = reports.summary(rows, ["id", "level"], "bytes").join(rows.groupBy("id", "level").agg(F.sum("bytes").alias("bytes")), ["id", "level"])
    return got.select("id", "level", "n", "bytes", "mean", "p50", "p90").withColumns(six("mean", "p50", "p90"))


@query("SELECT s.pair AS pair, count(*) AS n, CAST(sum(s.score) AS BIGINT) AS score, CAST(sum(b.label) AS BIGINT) AS label FROM (SELECT l_orderkey AS pair, l_linenumber AS i, l_partkey AS score FROM lineitem) s JOIN (SELECT l_orderkey AS pair, l_linenumber AS i, l_suppkey % 2 AS label FROM lineitem WHERE l_linenumber <= 3) b USING (pair, i) GROUP BY ALL")
def scores_with_labels(spark, d):
    """Scores and labels by tile, as far as both go."""
    items = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("score"), (F.col("l_suppkey") % 2).alias("label"))
    met = items.select("pair", "i", "score").join(items.filter("i <= 3").select("pair", "i", "label"), ["pair", "i"])
    return met.groupBy("pair").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("label").alias("label"))


@query(f"WITH {RUNS} SELECT image, y, start_x, len, label, row_number() OVER (PARTITION BY image ORDER BY y, start_x) - 1 AS place FROM runs")
def runs_lexsorted(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("image").orderBy("y", "start_x")) - 1
    return image_runs(spark, d).select("image", "y", "start_x", "len", "label", place.cast("long").alias("place"))


@query("SELECT c_custkey AS stem, arg_min(path, (priority, path)) AS path FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey || '.png' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 3 END AS priority FROM orders) f ON c_custkey = o_custkey GROUP BY ALL")
def same_folder_resolution(spark, d):
    wanted = views.read(spark, d, "customer").select(F.col("c_custkey").alias("stem"))
    files = views.read(spark, d, "orders").select(F.col("o_custkey").alias("stem"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"), (F.col("o_orderkey") % 3 + 1).alias("priority"))
    return reports.resolved(wanted, files, "stem").select("stem", "path")


# --- codecs, which SQL doesn't have


def tile_classic_bits(spark, d):
    """Compressed bits of each tile's residual."""
    from pyspark.sql import Window

    rows = catalogue._residuals(spark, d)
    width = F.max(F.col("x") + 1).over(Window.partitionBy(*KEY, "y"))
    return codecs.tile_surprise(rows.withColumn("w", width), KEY, 8, 8, F.lit(10), F.col("w"), "zlib", 6)


QUERIES["tile_classic_bits"] = tile_classic_bits


def _coded(spark, d) -> DataFrame:
    rows = image_runs(spark, d)
    return run_codec.coded(rows, run_codec.fitted(rows.filter(catalogue.is_train()), rows))


def run_codec_files(spark, d):
    """Each image's coded runs under fixed and under growing counts: sizes, the ideal, and whether decoding gives the image again."""
    return manifests.coder_overheads(_coded(spark, d)).withColumns(six("label_bits", "ideal_bits", "overhead_pct", "header_pct"))


def run_codec_matrix(spark, d):
    """Medians and 90th percentiles of ideal and actual bits a pixel by mode and split."""
    rows = manifests.coder_overheads(_coded(spark, d)).withColumn("split", F.when(catalogue.is_train(), "train").otherwise("val"))
    area = F.col("h") * F.col("w")
    shares = {"ideal_bbp": F.col("ideal_bits") / area, "length_bbp": (F.col("ideal_bits") - F.col("label_bits")) / area, "actual_bbp": F.col("bits_payload") / area, "overhead": F.col("overhead_pct"), "header": F.col("header_pct")}
    got = rows.groupBy("mode", "split").agg(F.count("*").alias("n"), *(F.percentile(x, F.lit(q)).alias(f"{c}_{tag}") for c, x in shares.items() for tag, q in (("p50", 0.5), ("p90", 0.9))))
    return got.withColumns(six(*(c for c in got.columns if c.endswith(("_p50", "_p90")))))


def mask_benchmark(spark, d):
    return codecs.mask_benchmark(pixels(spark, d), IMAGE, ("zlib", "lzma", "zstd"), (1, 6, 9)).withColumns(six("bbp"))


def mask_benchmark_tiles(spark, d):
    got = codecs.tile_benchmark(pixels(spark, d), IMAGE, 16, ("zlib", "zstd"), (6,))
    return got.withColumns(six("bbp", "bbp_mean", "bbp_p50", "bbp_p90"))


def stream_baselines(spark, d):
    """Each image's token stream as 32-bit numbers, by lzma presets and zstd levels."""
    lines = runs.scanline(pixels(spark, d), IMAGE, F.col("label"))
    shapes = lines.groupBy("image").agg((F.max("h") * F.max("w")).alias("pixels"))
    tokens = runs.contract_tokens(lines, IMAGE).join(shapes, "image")
    named = tokens.select(F.col("image").cast("string").alias("dataset"), streams.int32_bytes(F.col("tokens")).alias("data"), "pixels", F.size("tokens").cast("long").alias("tokens"))
    return codecs.stream_baselines(named).withColumns(six("bits_per_pixel", "bits_per_token"))


QUERIES |= {f.__name__: f for f in (run_codec_files, run_codec_matrix, mask_benchmark, mask_benchmark_tiles, stream_baselines)}
