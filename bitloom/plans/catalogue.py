"""The registered queries of the engine; their SQL is in sql.py under the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import change, codecs, entropy, ppm, ranges, reports, runs
from ..sources import views
from .sql import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
IMAGE = ["image"]
WIDTH, VOCAB, ALPHABET = 64, 4, 68


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(*names: str) -> dict:
    return {n: F.round(F.col(n).cast("double"), 6) for n in names}


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return views.embedding_pixels(spark, d)


def image_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(pixels(spark, d), IMAGE)


def is_train():
    return F.expr("(image div 4) % 5 <> 0")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


# --- runs, tokens, tiles


@query
def runs_rowwise(spark, d):
    return image_runs(spark, d).select("image", "y", "run_idx", "start_x", "len", "label")


@query
def runs_decode_check(spark, d):
    px = pixels(spark, d).withColumnRenamed("label", "want")
    back = runs.decode(runs.runs(px.withColumnRenamed("want", "label"), IMAGE), IMAGE)
    met = px.join(back, ["image", "y", "x"], "full")
    return met.groupBy("image").agg(F.count("*").alias("n_pixels"), F.sum((~F.col("want").eqNullSafe(F.col("label"))).cast("long")).alias("n_wrong"))


@query
def tokens_typed(spark, d):
    return runs.typed_tokens(image_runs(spark, d), IMAGE).select("image", "y", "t", "token", F.col("token_type").cast("int").alias("token_type"), "rem_width")


@query
def label_dim(spark, d):
    return runs.label_index(pixels(spark, d))


@query
def row_items_above(spark, d):
    px = pixels(spark, d)
    got = runs.above(runs.runs(px, IMAGE), px, IMAGE)
    return got.select("image", "y", "run_idx", "label", "above_label", "above_rem", (F.col("above_label") == F.col("label")).cast("int").alias("above_same"))


@query
def runs_scanline_v0(spark, d):
    tokens = runs.contract_tokens(runs.scanline(pixels(spark, d), IMAGE, (F.col("label") > 1).cast("int")), IMAGE)
    return tokens.select("image", F.size("tokens").cast("long").alias("n_tokens"), F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"), runs.contract_errors(F.col("tokens")).alias("error"))


@query
def token_offsets(spark, d):
    lens = runs.scanline(pixels(spark, d), IMAGE, (F.col("label") > 1).cast("int")).groupBy("image").agg((2 * F.count("*") + 4).alias("token_len"))
    return ranges.running(lens, "image", {"upto": "token_len"}).select("image", "token_len", (F.col("upto") - F.col("token_len")).cast("long").alias("token_offset"))


@query
def stream_stats(spark, d):
    per = runs.scanline(pixels(spark, d), IMAGE, (F.col("label") > 1).cast("int")).groupBy("image").agg((2 * F.count("*") + 4).alias("n"), F.first(F.col("h") * F.col("w")).alias("area"))
    return per.agg(F.count("*").alias("num_masks"), F.sum("area").alias("total_pixels"), F.sum("n").alias("total_tokens"), (F.sum("n") / F.sum("area")).alias("mean_tokens_per_pixel"), F.avg("n").alias("mean_token_len"), F.avg((F.col("n") - 4) / 2).alias("mean_runs_per_mask")).withColumns(six("mean_tokens_per_pixel", "mean_token_len", "mean_runs_per_mask"))


@query
def unified_tokens(spark, d):
    return runs.unified_tokens(image_runs(spark, d), IMAGE, VOCAB, WIDTH)


@query
def cache_manifest(spark, d):
    px = pixels(spark, d)
    labels = px.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_join(F.transform(F.sort_array(F.collect_set("label")), lambda x: x.cast("string")), "|").alias("unique_vals"))
    return labels.join(image_runs(spark, d).groupBy("image").agg(F.count("*").alias("total_runs")), "image")


def _located(spark, d) -> DataFrame:
    heights = sizes(spark, d).select("image", "h")
    spans = ranges.running(heights, "image", {"last": "h"}).withColumn("first", F.col("last") - F.col("h"))
    return spans.withColumn("row_idx", F.explode(F.expr("sequence(first, last - 1)"))).select("row_idx", "image", (F.col("row_idx") - F.col("first")).alias("y"))


@query
def row_locate(spark, d):
    """Every 37th row of row_locate_all, as its SQL has it."""
    return _located(spark, d).filter("row_idx % 37 = 0")


@query
def row_locate_all(spark, d):
    """Every global row by the image whose offset range holds it."""
    return _located(spark, d)


@query
def delta_left_hist(spark, d):
    return runs.delta_left(views.lineitem_pixels(spark, d), ["sample", "t"]).groupBy("t", "delta").agg(F.count("*").alias("n"))


@query
def rle_stream_size(spark, d):
    rows = runs.runs(views.lineitem_pixels(spark, d), ["sample", "t"])
    return rows.groupBy("sample", "t").agg(F.sum(1 + runs.varint_size(F.col("len"))).cast("long").alias("bytes"))


@query
def packed_size(spark, d):
    return views.lineitem_pixels(spark, d).groupBy("sample", "t").agg(codecs.packed_bits_size(F.count("*")).alias("bytes"), F.sum((F.col("label") > 0).cast("long")).alias("ones"))


@query
def context_windows_t16(spark, d):
    rows = runs.windows(views.event_pixels(spark, d), IMAGE, "x", "label", 16, -1)
    return rows.select("image", "x", "label", F.array_join(F.transform("context", lambda c: c.cast("string")), ",").alias("context"))


@query
def boundary_pixels(spark, d):
    return runs.boundaries(views.lineitem_pixels(spark, d), ["sample", "t"]).groupBy("sample", "t", "y").agg(F.count("*").alias("n"))


# --- count-based models


def _label_bits(order: int, reset: bool):
    def run(spark, d):
        rows = entropy.label_contexts(image_runs(spark, d), order, reset)
        got = entropy.label_bits(rows.filter(is_train()), rows, order)
        return got.groupBy("image").agg(F.count("*").alias("n_runs"), F.sum("bits_label").alias("bits")).withColumns(six("bits"))

    return run


for _n in (1, 2, 3):
    QUERIES[f"ngram_label_bits_o{_n}"] = _label_bits(_n, True)
QUERIES["ngram_label_bits_o2_carry"] = _label_bits(2, False)


def _features(spark, d, mode: str) -> DataFrame:
    px = pixels(spark, d)
    rows = runs.runs(px, IMAGE)
    if mode.startswith("above"):
        rows = runs.above(rows, px, IMAGE)
    return entropy.length_features(rows)


def _length_bits(mode: str):
    def run(spark, d):
        rows = _features(spark, d, mode)
        got = entropy.length_bits(rows.filter(is_train()), rows, mode, WIDTH)
        return got.groupBy("image").agg(F.sum("bits_len").alias("bits")).withColumns(six("bits"))

    return run


for _m in entropy.MODES:
    QUERIES[f"len_bits_{_m}"] = _length_bits(_m)


def scored_runs(spark, d) -> DataFrame:
    rows = entropy.label_contexts(_features(spark, d, "above"), 2)
    rows = entropy.label_bits(rows.filter(is_train()), rows, 2)
    return entropy.length_bits(rows.filter(is_train()), rows, "above", WIDTH)


@query
def ngram_image_bbp(spark, d):
    got = entropy.image_bits(scored_runs(spark, d), sizes(spark, d))
    return got.select("image", "h", "w", *(F.round(c, 6).alias(c) for c in ("bits_label", "bits_len", "bits_total", "bbp", "bbp_label", "bbp_len", "len_frac")))


@query
def ngram_tile_heat(spark, d):
    return entropy.tile_means(scored_runs(spark, d), 12, sizes(spark, d)).withColumns(six("heat"))


@query
def ngram_heat_stats(spark, d):
    got = reports.summary(entropy.tile_means(scored_runs(spark, d), 12, sizes(spark, d)), ["image"], "heat")
    return got.withColumns(six("mean", "p50", "p90", "least", "greatest"))


def _tokens(spark, d) -> DataFrame:
    return runs.unified_tokens(image_runs(spark, d), IMAGE, VOCAB, WIDTH)


ROW, AT = ["image", "y"], ["t"]


def _kt(weights, z: str | None):
    def run(spark, d):
        rows = _tokens(spark, d)
        train = rows.filter(is_train())
        given = entropy.evidence_weights(entropy.evidence(train, 2, ALPHABET, ROW, AT), 2) if weights == "evidence" else weights
        n = 2 if weights == "evidence" else len(weights)
        got = entropy.kt_mixture(train, rows, given, ALPHABET, ROW, AT, n)
        cost = {"type": F.when(F.col("lo") == 0, F.col("p") / F.col("z")).otherwise(F.col("p")), "both": F.col("p") / F.col("z")}.get(z, F.col("p"))
        return got.groupBy("image").agg(F.sum(entropy.bits(F.greatest(cost, F.lit(1e-12)))).alias("bits")).withColumns(six("bits"))

    return run


QUERIES |= {"kt_order0_bits": _kt([1.0], None), "kt_order1_bits": _kt([0.0, 1.0], None), "kt_order2_bits": _kt([0.0, 0.0, 1.0], None)}
QUERIES |= {"ktmix_uniform": _kt([0.5, 0.5], None), "ktmix_evidence_weights": _kt("evidence", None), "ktmix_type_renorm": _kt([0.5, 0.5], "type"), "ktmix_len_renorm": _kt([0.5, 0.5], "both")}


@query
def kt_log_evidence(spark, d):
    return entropy.evidence(_tokens(spark, d).filter(is_train()), 3, ALPHABET, ROW, AT).select("k", F.round("log_evidence", 4).alias("log_evidence"))


@query
def ppm_bits(spark, d):
    rows = _tokens(spark, d)
    got = ppm.score(rows.filter(is_train()), rows, 3, ALPHABET, ROW, AT)
    return got.groupBy("image").agg(F.sum(entropy.bits(F.greatest(F.col("p") / F.col("z"), F.lit(1e-12)))).alias("bits")).withColumns(six("bits"))


@query
def markov2_xent(spark, d):
    counted = views.byte_contexts(views.read(spark, d, "documents"))
    train = counted.filter("doc_id % 5 <> 0").groupBy("b2", "b1", "b").agg(F.sum("c").alias("c"))
    got = entropy.markov_bits(train, counted.filter("doc_id % 5 = 0").groupBy("b2", "b1", "b").agg(F.sum("c").alias("c")))
    return got.agg(F.sum("c").alias("n_bytes"), (F.sum(F.col("c") * F.col("e")) / F.sum("c")).alias("bits_per_byte"), (F.sum(F.col("c") * F.col("e")) / 8).alias("est_bytes")).withColumns(six("bits_per_byte") | {"est_bytes": F.round("est_bytes", 2)})


@query
def markov2_per_doc(spark, d):
    counted = views.byte_contexts(views.read(spark, d, "documents"))
    train = counted.filter("doc_id % 5 <> 0").groupBy("b2", "b1", "b").agg(F.sum("c").alias("c"))
    got = entropy.markov_bits(train, counted)
    return got.groupBy("doc_id").agg(F.sum("c").alias("n_bytes"), F.sum(F.col("c") * F.col("e")).alias("bits")).withColumns({"bits": F.round("bits", 4)})


# --- change


def _frames(spark, d) -> DataFrame:
    split = F.when(F.col("facade") % 5 == 0, "val").otherwise("train")
    return sizes(spark, d).select(F.expr("image div 4").alias("facade"), (F.col("image") % 4).alias("t"), "image").select(F.col("facade").alias("sample"), split.alias("split"), F.concat(F.lit("img"), F.col("image").cast("string")).alias("stem"), (2000 + F.col("t")).alias("sort_key"), "t")


@query
def pairs_delta1(spark, d):
    return change.pairs(_frames(spark, d), 1)


@query
def pairs_delta2(spark, d):
    return change.pairs(_frames(spark, d), 2)


@query
def split_leakage(spark, d):
    return change.leaking(_frames(spark, d)).agg(F.count("*").alias("n_leaking"))


def _residuals(spark, d) -> DataFrame:
    px = views.lineitem_pixels(spark, d)
    before = px.filter("t < 2").select("sample", (F.col("t") + 1).alias("t"), "y", "x", "label")
    return change.residual(before, px.filter("t > 0"), ["sample", "t"])


KEY = ["sample", "t"]


def _width(spark, d):
    return _residuals(spark, d).agg((F.max("x") + 1).alias("w"))


def _tiles(spark, d, tile=8, stride=8) -> DataFrame:
    got = _residuals(spark, d)
    return change.tile_scores(got.withColumn("w", F.max(F.col("x") + 1).over(Window.partitionBy("sample", "t", "y"))), KEY, tile, stride, 10, F.col("w"))


@query
def residual_pixels(spark, d):
    return _residuals(spark, d).filter("c = 1").select("sample", "t", "y", "x", "prev", "cur", "v")


@query
def residual_reconstruct_diff(spark, d):
    return change.reconstruct(_residuals(spark, d)).groupBy(*KEY).agg(F.sum("c").cast("long").alias("n_changed"), F.sum((F.col("rebuilt") != F.col("cur")).cast("long")).alias("n_wrong"))


@query
def tile_changed_frac(spark, d):
    return _tiles(spark, d).select(*KEY, "gy", "gx", F.round("changed_frac", 6).alias("changed_frac"))


@query
def tile_iid_bits(spark, d):
    return _tiles(spark, d).select(*KEY, "gy", "gx", F.round("iid_bits", 6).alias("iid_bits"))


@query
def tile_iid_bits_overlap(spark, d):
    return _tiles(spark, d, 8, 4).select(*KEY, "gy", "gx", F.round("iid_bits", 6).alias("iid_bits"))


@query
def tile_scores(spark, d):
    area = F.first("area")
    rows = _tiles(spark, d, 8, 4).crossJoin(F.broadcast(_width(spark, d).select((F.col("w") * 10).alias("area"))))
    return change.pair_scores(rows, KEY, F.col("area"), "iid_bits").withColumns(six("bbp_heat", "heat_min", "heat_p50", "heat_p90", "heat_max"))


def _labelled(spark, d) -> DataFrame:
    rows = _tiles(spark, d, 8, 4)
    return rows.select(F.concat_ws("_", "sample", "t").alias("pair"), (F.col("gy") * 100000 + F.col("gx")).alias("tile"), F.round("iid_bits", 6).alias("score"), (F.col("changed_frac") >= 0.5).cast("int").alias("label"))


@query
def tile_labels(spark, d):
    return _labelled(spark, d).groupBy("pair").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query
def roc_auc(spark, d):
    return change.roc_auc(_labelled(spark, d)).withColumns(six("auc"))


@query
def pr_auc(spark, d):
    return change.average_precision(_labelled(spark, d)).withColumns(six("ap"))


@query
def roc_auc_one_class(spark, d):
    return change.roc_auc(_labelled(spark, d).withColumn("label", F.lit(1))).withColumns(six("auc"))


@query
def hit_recall_at_k(spark, d):
    return change.hit_and_recall(_labelled(spark, d), 5).withColumns(six("hit_at_k", "recall_at_k"))


@query
def tile_density_heat(spark, d):
    """Label bits of runs, spread over their pixels, as means over whole tiles of 8 by 8."""
    rows = entropy.label_contexts(image_runs(spark, d), 2)
    got = entropy.label_bits(rows, rows, 2).withColumn("bits_len", F.lit(0.0))
    return entropy.tile_means(got, 8, sizes(spark, d)).join(sizes(spark, d), "image").filter("(gy + 1) * 8 <= h and (gx + 1) * 8 <= w").select("image", "gy", "gx", F.round("heat", 6).alias("heat"))


# --- reports, on rows made of line items


def _results(spark, d) -> DataFrame:
    items = views.read(spark, d, "lineitem")
    codec = F.when(F.col("l_returnflag") == "A", " LZMA").when(F.col("l_returnflag") == "N", "zstd ").otherwise("bz2")
    return items.select((F.col("l_suppkey") % 10).alias("id"), F.col("l_orderkey").alias("filename"), scalars.codec_name(codec).alias("codec"), F.col("l_linenumber").cast("int").alias("level"), F.col("l_quantity").cast("long").alias("bytes_out"), (F.col("l_partkey") % 7).alias("h"), (F.col("l_partkey") % 5).alias("w"), (F.col("l_extendedprice") / 1000).alias("bbp"))


@query
def weighted_bbp(spark, d):
    return reports.weighted_bbp(_results(spark, d), ["codec", "level"]).withColumns(six("bbp_weighted"))


@query
def best_codecs(spark, d):
    got = reports.weighted_bbp(_results(spark, d), ["codec", "level"])
    return got.orderBy("bbp_weighted", "codec", "level").limit(5).select("codec", "level", F.round("bbp_weighted", 6).alias("bbp_weighted"))


@query
def seq_codec_mean(spark, d):
    return _results(spark, d).filter(F.col("codec").isin("lzma", "zstd")).groupBy("id", "codec", "level").agg(F.avg("bbp").alias("bbp")).withColumns(six("bbp"))


@query
def codec_level_pivot(spark, d):
    got = reports.level_pivot(_results(spark, d), ["id", "codec"], [1, 3, 6], "bbp")
    return got.withColumns(six("level_1", "level_3", "level_6"))


@query
def run_summary(spark, d):
    return reports.summary(_results(spark, d), ["id", "codec"], "bbp").withColumns(six("mean", "p50", "p90", "least", "greatest"))


@query
def topk_hard(spark, d):
    rows = _results(spark, d).groupBy("id", "filename").agg(F.max("bbp").alias("bbp"))
    return rows.orderBy(F.desc("bbp"), "id", "filename").limit(20).withColumns(six("bbp"))


@query
def topk_unique_facade(spark, d):
    rows = _results(spark, d).groupBy("id", "filename").agg(F.max("bbp").alias("bbp"))
    return reports.first_row(rows, ["id"], [F.desc("bbp"), F.col("filename")]).withColumns(six("bbp"))


@query
def best_epoch(spark, d):
    log = views.read(spark, d, "orders").groupBy(F.month("o_orderdate").cast("long").alias("epoch")).agg((F.avg("o_totalprice") / 1e5).alias("val_bbp"))
    return log.agg(F.min_by("epoch", F.struct("val_bbp", "epoch")).alias("best_epoch"), F.min("val_bbp").alias("best_bbp"), F.max_by("epoch", F.struct("val_bbp", "epoch")).alias("worst_epoch")).withColumns(six("best_bbp"))


def _merged(spark, d, c: str, v: str) -> DataFrame:
    orders = views.read(spark, d, "orders")
    side = lambda kept, name: orders.filter(kept).select(F.col("o_orderkey").alias("pair_id"), (F.col("o_totalprice") / 1000).alias(name))
    return reports.merge_one_to_one(side(c, "bits_c"), side(v, "bits_v"), "pair_id").withColumn("bits_sum", F.col("bits_c") + F.col("bits_v")).withColumns(six("bits_c", "bits_v", "bits_sum"))


@query
def lm_cv_merge(spark, d):
    """Pairs that stand in both of two parts of the orders, as its SQL has it."""
    return _merged(spark, d, "o_orderkey % 3 <> 0", "o_orderkey % 3 <> 1")


@query
def lm_cv_merge_all(spark, d):
    return _merged(spark, d, "true", "true")


@query
def hybrid_bbp(spark, d):
    pairs = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), (F.col("o_totalprice") / 1000).alias("bbp_heat"))
    items = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("place"), "l_returnflag", F.col("l_extendedprice").alias("bits"))
    ranked = lambda flag, name: items.filter(F.col("l_returnflag") == flag).groupBy("pair_id", "place").agg(F.max("bits").alias(name))
    got = reports.hybrid(pairs, ranked("A", "bits_c"), ranked("N", "bits_v"), F.lit(1e4), "place")
    return got.withColumns(six("bbp_heat", "bits_c", "bits_v", "bbp_hybrid", "bbp"))


@query
def metrics_merge(spark, d):
    o = views.read(spark, d, "orders")
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("auc"))
    b = o.filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("method"))
    return reports.union_all([a, b]).select("id", F.round("auc", 6).alias("auc"), "method")


@query
def metrics_dedupe_last(spark, d):
    rows = views.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return reports.last_row(rows, ["o_custkey"], "o_orderkey")


@query
def metrics_parse_tau_k(spark, d):
    rows = views.read(spark, d, "part").select("p_partkey", F.concat(F.lit("iid_tau0."), (F.col("p_size") % 10).cast("string"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("_k"), F.col("p_size").cast("string"))).otherwise("")).alias("method"))
    return rows.withColumns(scalars.tau_and_k(F.col("method")))


@query
def name_parse(spark, d):
    key = F.col("p_partkey")
    digits = key.cast("string")
    frame = F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), "0")  # a plain lpad cuts longer numbers
    name = F.concat(F.lit("c"), (key % 9).cast("string"), F.lit("_"), F.lpad((key % 4).cast("string"), 6, "0"), F.lit("_"), frame, F.lit("_gtFine_labelIds.png"))
    tile = F.concat(F.lit("m"), key.cast("string"), F.lit("__gy"), (key % 13).cast("string"), F.lit("__gx"), (key % 17).cast("string"), F.lit(".png"))
    years = F.concat((1990 + key % 40).cast("string"), F.lit("_"), (2000 + key % 30).cast("string"), F.lit("_x.PNG"))
    rows = views.read(spark, d, "part").select("p_partkey", name.alias("name"), tile.alias("tile"), years.alias("years"))
    parsed = scalars.city_name(F.col("name")) | {k: v for k, v in scalars.tile_name(F.col("tile")).items() if k != "stem"}
    first, second = scalars.year_pair(F.col("years"))
    return rows.select("p_partkey", *(v.alias(k) for k, v in parsed.items()), first.alias("y1"), second.alias("y2"), scalars.last_year(F.concat(F.lit("a"), F.col("years"))).alias("last_year"))


@query
def image_resolution(spark, d):
    wanted = views.read(spark, d, "customer").select(F.col("c_custkey").alias("stem"))
    files = views.read(spark, d, "orders").select(F.col("o_custkey").alias("stem"), F.expr("array_position(array('1-URGENT','2-HIGH','3-MEDIUM'), o_orderpriority)").cast("int").alias("priority"), F.concat(F.lit("images/"), F.col("o_orderkey").cast("string")).alias("path")).filter("priority > 0")
    return reports.resolved(wanted, files, "stem")


@query
def local_normalise(spark, d):
    return reports.normalised(_results(spark, d).groupBy("id", "filename").agg(F.max("bbp").alias("bbp")), ["id"], "bbp").withColumns(six("bbp", "norm"))


# --- codecs


@query
def codec_sizes(spark, d):
    return codecs.codec_sizes(codecs.raster_bytes(pixels(spark, d), IMAGE))


@query
def residual_codec(spark, d):
    return codecs.residual_sizes(_residuals(spark, d), KEY, ("lzma", "zstd")).withColumns(six("bbp"))


@query
def codec_tile_sizes(spark, d):
    px = pixels(spark, d).withColumns({"gy": F.expr("y div 8"), "gx": F.expr("x div 8")})
    sized = codecs.codec_sizes(codecs.raster_bytes(px, ["image", "gy", "gx"]), ("zlib",), (6,))
    return sized.groupBy("image", "codec", "level").agg(F.count("*").alias("tiles"), F.sum("bytes_out").alias("bytes_out"), F.percentile(F.col("bytes_out").cast("double"), F.lit(0.5)).alias("p50"), F.percentile(F.col("bytes_out").cast("double"), F.lit(0.9)).alias("p90"))


def _order1(spark, d) -> DataFrame:
    px = pixels(spark, d)
    before = F.lag("label", 1, -1).over(Window.partitionBy("image").orderBy("y", "x"))
    counts = px.withColumn("before", before).groupBy("before", "label").agg(F.count("*").alias("c"))
    all_pairs = spark.range(-1, VOCAB).withColumnRenamed("id", "before").crossJoin(spark.range(VOCAB).withColumnRenamed("id", "label"))
    return all_pairs.join(counts, ["before", "label"], "left").select("before", F.col("label").alias("sym"), (F.coalesce("c", F.lit(0)) + 0.5).alias("p"))


@query
def cdf_quantised(spark, d):
    return codecs.frequencies(_order1(spark, d), ["before"]).select("before", "sym", "freq", "cum")


@query
def arith_roundtrip(spark, d):
    streams = pixels(spark, d).groupBy("image").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "label"))), lambda p: p["label"]).alias("symbols"))
    return codecs.arithmetic_roundtrip(streams, codecs.frequencies(_order1(spark, d), ["before"])).withColumns({"ideal_bits": F.round("ideal_bits", 6)})
