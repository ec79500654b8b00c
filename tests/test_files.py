"""Folder scans, sinks and distributed running sums on small inputs."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import manifests, ranges, runs, streams
from bitloom.sources import png, scans, sinks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


MASK = np.array([[1, 2], [3, 300]], np.uint16)


def test_scans_of_folder_layouts(spark, tmp_path):
    for name in ("f1/a/x.png", "f1/b/y.png", "f2/a/z.png", "f3/other/n.png"):
        put(tmp_path / "multi" / name, png.encode(MASK))
    got = scans.subfolders(spark, str(tmp_path / "multi"), ["a", "b", "c"]).select("facade_id", "subdir", "name").collect()
    assert sorted(map(tuple, got)) == [("f1", "a", "x.png"), ("f1", "b", "y.png"), ("f2", "a", "z.png")]
    with pytest.raises(ValueError, match="no PNG folder"):
        scans.subfolders(spark, str(tmp_path / "multi"), ["c"])
    for name in ("train/u/x_gtFine_labelIds.png", "train/u/x_color.png", "val/w/y_gtFine_labelIds.png"):
        put(tmp_path / "city" / name, b"x")
    assert sorted((r.split, r.name) for r in scans.split_files(spark, str(tmp_path / "city")).collect()) == [("train", "x_gtFine_labelIds.png"), ("val", "y_gtFine_labelIds.png")]
    for name in ("s1/label/cam_front/0.png", "s1/label/cam_front/1.png", "s2/label/cam_rear/0.png"):
        put(tmp_path / "drive" / name, b"x")
    assert [tuple(r) for r in scans.scenes(spark, str(tmp_path / "drive"), "front").collect()] == [("s1", 2)]
    for name in ("d/x.tif", "d/e/y.PNG", "z.tiff", "no.jpg"):
        put(tmp_path / "deep" / name, b"x")
    assert sorted(r.name for r in scans.all_masks(spark, str(tmp_path / "deep")).collect()) == ["x.tif", "y.PNG", "z.tiff"]


def test_choice_of_folders(spark, tmp_path):
    (tmp_path / "set" / "train" / "label").mkdir(parents=True)
    assert scans.dataset_root(spark, str(tmp_path), "set") == f"{tmp_path}/set"
    assert scans.mask_folder(spark, f"{tmp_path}/set", "train").endswith("/label")
    (tmp_path / "set" / "train" / "mask").mkdir()
    assert scans.mask_folder(spark, f"{tmp_path}/set", "train").endswith("/mask")
    with pytest.raises(ValueError):
        scans.mask_folder(spark, f"{tmp_path}/set", "val")


def test_class_lists_keep_the_order_of_the_file(spark, tmp_path):
    put(tmp_path / "c.json", json.dumps({"#ff0000": "car", "#000001": "road"}).encode())
    assert scans.class_list(spark, str(tmp_path / "c.json")) == [(255, 0, 0, "car", 0), (0, 0, 1, "road", 1)]
    for bad in ('{"red": "x"}', '{"#FF0000": "a", "#ff0000": "b"}'):
        put(tmp_path / "bad.json", bad.encode())
        with pytest.raises(ValueError):
            scans.class_list(spark, str(tmp_path / "bad.json"))
    put(tmp_path / "m.json", json.dumps([{"stem": "s", "gh": 1, "gw": 2, "tile": 8, "stride": 8}]).encode())
    assert tuple(scans.tile_meta(spark, str(tmp_path / "m.json")).first()) == ("s", 1, 2, 8, 8)


def test_bundles_run_bits_heat_and_streams(spark, tmp_path):
    held = io.BytesIO()
    np.savez_compressed(held, row_ptr=np.array([0, 1]), labels=np.array([3]), lengths=np.array([2]), above=np.array([65535]))
    put(tmp_path / "cache" / "a.npz", held.getvalue())
    r = scans.row_bundles(spark, str(tmp_path / "cache")).first()
    assert (r.row_ptr, r.labels, r.lengths, r.above) == ([0, 1], [3], [2], [65535])
    sinks.run_bits_file(np.array([1, 0, 1]), np.array([2, 0, 0]), np.array([1, 3, 2]), np.array([0.5, 1.5, 2.5]), str(tmp_path / "bits" / "a.npz"))
    assert [(r.y, r.start, r.length, r.bits) for r in scans.run_bits(spark, str(tmp_path / "bits")).collect()] == [(0, 0, 3, 1.5), (1, 0, 2, 2.5), (1, 2, 1, 0.5)]
    sinks.heat_files(np.array([[0.0, 1.0], [2.0, 4.0]]), str(tmp_path / "heat" / "p"))
    assert sorted(map(tuple, scans.heat_maps(spark, str(tmp_path / "heat")).collect())) == [("p", 0, 0, 0.0), ("p", 0, 1, 1.0), ("p", 1, 0, 2.0), ("p", 1, 1, 4.0)]
    assert png.decode((tmp_path / "heat" / "p.png").read_bytes()).tolist() == [[0, 64], [128, 255]]
    assert not sinks.stretched(np.full((2, 2), 7.0)).any()
    (tmp_path / "streams").mkdir()
    rows = spark.createDataFrame([(2, [5]), (1, [-1, 7])], "i long, t array<long>")
    assert sinks.int32_stream(rows, ["i"], "t", str(tmp_path / "streams" / "s.int32.bin")) == 3
    put(tmp_path / "streams" / "s.stats.json", b'{"total_pixels": 9, "total_tokens": 3}')
    put(tmp_path / "streams" / "u.int32.bin", b"\0\0\0\0")
    found = scans.token_streams(spark, str(tmp_path / "streams"))
    got = {r.name: (np.frombuffer(r.data, "<i4").tolist(), r.total_pixels) for r in found.collect()}
    assert got == {"s": ([-1, 7, 5], 9), "u": ([0], None)}
    with pytest.raises(Exception, match="positive"):
        scans.checked_totals(found).collect()


def test_sinks_write_tables_masks_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a_b"), (2, None)], "k long, v string")
    for _ in range(2):
        sinks.csv_file(rows.orderBy("k"), str(tmp_path / "r.csv"), ["k", "v"], append=True)
    assert (tmp_path / "r.csv").read_text().splitlines() == ["k,v", "1,a_b", "2,", "1,a_b", "2,"]
    assert sinks.latex(rows.orderBy("k")).splitlines()[4] == r"1 & a\_b \\"
    sinks.json_file({"b": 1, "a": 2}, str(tmp_path / "x.json"))
    assert list(json.loads((tmp_path / "x.json").read_text())) == ["a", "b"]
    masks = spark.createDataFrame([("m.png", 2, 2, MASK.reshape(-1).tolist())], "name string, h int, w int, labels array<long>")
    assert sinks.mask_files(masks, str(tmp_path / "m"), 400) == 1
    assert (png.decode((tmp_path / "m" / "m.png").read_bytes()) == MASK).all()
    sinks.split_lists(spark.createDataFrame([("val", 3), ("val", 1), ("train", 2)], "split string, k long"), "k", str(tmp_path / "s"))
    assert (tmp_path / "s" / "val.txt").read_text() == "1\n3\n"
    with pytest.raises(ValueError, match="more than"):
        sinks.csv_file(rows, str(tmp_path / "y.csv"), ["k"], most=1)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_running_sums_over_ranges(spark, monkeypatch, parts):
    draw = np.random.default_rng(parts)
    values = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(draw.integers(0, 40, (300, 2)))]
    rows = spark.createDataFrame(values, "k long, i long, v long")
    monkeypatch.setattr(ranges.cuts, "__defaults__", (parts,))
    got = {r.i: r.s for r in ranges.running(rows, "k", {"s": "v"}, ("i",)).collect()}
    total, want = 0, {}
    for k, i, v in sorted(values):
        total += v
        want[i] = total
    assert got == want
    order = sorted(values)
    held = {r.i: (r.a, r.b) for r in ranges.carried(rows, "k", {"a": ("v", 1), "b": ("i", 3)}, ("i",)).collect()}
    assert held == {r[1]: (order[n - 1][2] if n else None, order[n - 3][1] if n > 2 else None) for n, r in enumerate(order)}


def test_running_sum_of_an_empty_table(spark):
    assert ranges.running(spark.createDataFrame([], "k long, v long"), "k", {"s": "v"}).count() == 0


def test_streams_have_their_bytes(spark):
    rows = [(0, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(np.array([[1] * 200, [0] * 100 + [2] * 100]))]
    px = spark.createDataFrame(rows, "image long, y long, x long, label long")
    made = streams.run_bytes(runs.runs(px, ["image"]), ["image"], 2).first().data
    assert bytes(made) == b"\1\0\xc8\1" + b"\0\0\x64" + b"\2\0\x64"
    flags = np.array([r[3] for r in sorted(rows)]) > 0
    assert bytes(streams.packed(px, ["image"], F.col("label") > 0).first().data) == np.packbits(flags, bitorder="little").tobytes()


def test_leaking_split_is_an_error(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "val")], "k string, split string")
    assert manifests.checked_split(rows, "k").count() == 2
    with pytest.raises(Exception, match="in train and in val"):
        manifests.checked_split(rows.unionByName(spark.createDataFrame([("a", "val")], rows.schema)), "k").collect()


def test_heat_of_a_pair_without_meta_is_an_error(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 1.0, 1), (1, 0, 0, 2.0, 2), (1, 9, 9, 5.0, 3)], "pair long, gy long, gx long, heat double, place long")
    meta = spark.createDataFrame([(1, 1, 2)], "pair long, gh long, gw long")
    assert sorted(map(tuple, manifests.heat_grid(tiles, meta, ["pair"], "place").collect())) == [(1, 0, 0, 2.0), (1, 0, 1, 0.0)]
    with pytest.raises(Exception, match="no meta"):
        manifests.heat_grid(tiles.withColumn("pair", F.lit(2).cast("long")), meta, ["pair"], "place").collect()


def test_raw_masks_keep_their_channels(spark, tmp_path):
    colour = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    put(tmp_path / "f" / "warped_masks" / "c.png", png.encode(colour))
    r = png.scan(spark, str(tmp_path), mode="raw").first()
    assert (r.h, r.w, r.channels, r.labels) == (2, 2, 3, list(range(12)))
    assert png.scan(spark, str(tmp_path)).first().error == "channels differ"


def test_unknown_colours_by_count(spark):
    rows = spark.createDataFrame([(1, 1, 1)] * 3 + [(2, 2, 2)] + [(9, 9, 9)] * 5, "r int, g int, b int")
    known = spark.createDataFrame([(9, 9, 9, 0)], "r int, g int, b int, class_id long")
    assert [tuple(r) for r in png.unknown_colours(rows, known).collect()] == [(1, 1, 1, 3), (2, 2, 2, 1)]


def test_tile_surprise_equals_direct_compression(spark):
    import zlib

    from bitloom.operators import change, codecs

    draw = np.random.default_rng(8)
    before, after = draw.integers(0, 3, (2, 8, 12))
    after[:4, :4] = before[:4, :4]
    frame = lambda a: spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "image long, y long, x long, label long")
    got = codecs.tile_surprise(change.residual(frame(before), frame(after), ["image"]), ["image"], 4, 2, F.lit(8), F.lit(12), "zlib", 6).collect()
    assert len(got) == 3 * 5
    for r in got:
        at = np.s_[r.gy * 2 : r.gy * 2 + 4, r.gx * 2 : r.gx * 2 + 4]
        c = before[at] != after[at]
        want = len(zlib.compress(np.packbits(c.reshape(-1), bitorder="little").tobytes(), 6)) + len(zlib.compress(np.where(c, after[at], 0).astype(np.uint8).tobytes(), 6))
        assert r.classic_bits == 8 * want
