import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import change, codecs, entropy, reports, runs
from bitloom.sources import lists, png
from bitloom.streaming import residuals


def frame(spark, masks):
    rows = [(i, int(y), int(x), int(v)) for i, m in masks.items() for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "image long, y long, x long, label long")


@pytest.fixture(scope="module")
def masks():
    draw = np.random.default_rng(123)
    return {i: draw.integers(0, 3, (int(draw.integers(1, 9)), int(draw.integers(1, 12)))) for i in range(6)}


def test_runs_decode_to_the_same_pixels(spark, masks):
    px = frame(spark, masks)
    made = runs.runs(px, ["image"])
    assert runs.check_rows(made, ["image"]).count() == 0
    assert px.exceptAll(runs.decode(made, ["image"]).select("image", "y", "x", "label")).count() == 0


def test_room_at_length_tokens(spark):
    made = runs.typed_tokens(runs.runs(frame(spark, {0: np.array([[1, 1, 1, 2, 2, 3, 3, 3]])}), ["image"]), ["image"])
    assert [r.rem_width for r in made.filter("token_type = 1").orderBy("t").collect()] == [8, 5, 3]


def test_contract_tokens_and_their_errors(spark, masks):
    lines = runs.scanline(frame(spark, masks), ["image"], (F.col("label") > 0).cast("int"))
    made = runs.contract_tokens(lines, ["image"])
    assert made.filter(runs.contract_errors(F.col("tokens")).isNotNull()).count() == 0
    broken = spark.createDataFrame([([999, 2, 2, 0, 4, -2],), ([-1, 2, 2, 0, 4],), ([-1, 2, 2, 0, 3, -2],), (None,)], "tokens array<long>")
    assert broken.filter(runs.contract_errors(F.col("tokens")).isNull()).count() == 0


def test_label_model_matches_a_plain_loop(spark, masks):
    made = entropy.label_contexts(runs.runs(frame(spark, masks), ["image"]), 2)
    got = {r.image: r.b for r in entropy.label_bits(made.filter("image < 4"), made, 2).groupBy("image").agg(F.sum("bits_label").alias("b")).collect()}
    counts, labels = {}, set()
    rows = {i: [[int(r[0])] + [int(b) for a, b in zip(r, r[1:]) if a != b] for r in m] for i, m in masks.items()}
    for i in range(4):
        for r in rows[i]:
            for a, b in zip([-1, *r], r):
                counts[a, b] = counts.get((a, b), 0) + 1
                labels.add(b)
    for i in masks:
        want = 0.0
        for r in rows[i]:
            for a, b in zip([-1, *r], r):
                n = sum(c for (x, _), c in counts.items() if x == a)
                want += np.log2(len(labels)) if b not in labels else -np.log2((counts.get((a, b), 0) + 0.5) / (n + 0.5 * len(labels)))
        assert abs(got[i] - want) < 1e-9


def test_residual_rebuilds_the_current_raster(spark):
    draw = np.random.default_rng(0)
    a, b = (frame(spark, {0: draw.integers(0, 10, (16, 16))}) for _ in range(2))
    assert change.reconstruct(change.residual(a, b, ["image"])).filter("rebuilt <> cur").count() == 0


def test_residual_sizes_have_both_streams(spark):
    draw = np.random.default_rng(6)
    before, after = draw.integers(0, 4, (2, 3, 5, 7))
    frame = lambda a: spark.createDataFrame([(i, y, x, int(a[i, y, x])) for i in range(3) for y in range(5) for x in range(7)], "image long, y long, x long, label long")
    got = codecs.residual_sizes(change.residual(frame(before), frame(after), ["image"]), ["image"], ("lzma", "zstd"), (1, 6)).collect()
    assert len(got) == 3 * 2 * 2
    for r in got:
        c = before[r.image] != after[r.image]
        size = lambda data: 8 * len(codecs.compressed(data, r.codec, r.level))  # noqa: E731, B023
        bits_c, bits_v = size(np.packbits(c.reshape(-1), bitorder="little").tobytes()), size(np.where(c, after[r.image], 0).astype(np.uint8).tobytes())
        assert (r.h, r.w, r.bits_c, r.bits_v, r.bits_sum, r.bbp) == (5, 7, bits_c, bits_v, bits_c + bits_v, (bits_c + bits_v) / 35)


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    assert abs(change.roc_auc(rows).first().auc - 0.875) < 1e-12
    assert abs(change.average_precision(rows).first().ap - (0.5 + 0.5 * 2 / 3)) < 1e-12
    assert change.roc_auc(rows.filter("label = 1")).first().auc is None


def test_repeated_key_is_an_error(spark):
    one, two = spark.createDataFrame([(1, 2)], "k int, a int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, b int")
    assert reports.merge_one_to_one(one, two.filter("b = 2"), "k").count() == 1
    with pytest.raises(Exception, match="repeated key"):
        reports.merge_one_to_one(one, two, "k").collect()


def test_mask_folder_scan(spark, tmp_path):
    where = tmp_path / "f1" / "warped_masks"
    where.mkdir(parents=True)
    mask = np.array([[1, 300], [2, 2]], np.uint16)
    (where / "a.png").write_bytes(png.encode(mask))
    (where / "b.png").write_bytes(b"no image")
    got = png.scan(spark, str(tmp_path))
    assert {r.name: r.error is None for r in got.collect()} == {"a.png": True, "b.png": False}
    assert sorted((r.y, r.x, r.label) for r in png.pixels(got).collect()) == [(0, 0, 1), (0, 1, 300), (1, 0, 2), (1, 1, 2)]


def test_colours_become_classes(spark):
    rows = spark.createDataFrame([(255, 0, 0), (1, 2, 3)], "r int, g int, b int")
    colours = spark.createDataFrame([(255, 0, 0, 1), (0, 0, 9, 2)], "r int, g int, b int, class_id long")
    assert sorted(r.class_id for r in png.class_ids(rows, colours, "map_last").collect()) == [1, 2]
    with pytest.raises(Exception, match="unknown RGB"):
        png.class_ids(rows, colours).collect()


def test_lists_and_splits(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b\n\n# note\na\nb\n")
    assert [r.id for r in lists.split_list(spark, str(tmp_path / "ids.txt"), comments=True).collect()] == ["b", "a"]
    got = lists.random_split(spark.range(10), "id", 0.25, 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"val": 2, "train": 8}


def test_stream_of_pairs(spark, tmp_path):
    spark.createDataFrame([("p", 2, [1, 1, 2, 2], [1, 3, 2, 2])], residuals.PAIR_SCHEMA).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(residuals.PAIR_SCHEMA).parquet(str(tmp_path / "in"))
    residuals.run(stream, 2, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).first().changed_frac == 0.25
