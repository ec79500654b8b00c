"""Coded runs against their models, and the codec benchmarks against the libraries."""

import lzma
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from bitloom.operators import codecs, entropy, run_codec, runs, streams
from bitloom.sources import png

WIDTH, HEIGHT = 19, 11


@pytest.fixture(scope="module")
def masks():
    draw = np.random.default_rng(5)
    return [np.repeat(np.repeat(draw.integers(3, 9, (6, 7)), 2, 0), 3, 1)[:HEIGHT, :WIDTH] for _ in range(6)]


@pytest.fixture(scope="module")
def pixels(spark, masks):
    rows = [(i, y, x, int(v)) for i, m in enumerate(masks) for y, line in enumerate(m) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image long, y long, x long, label long").cache()


def test_coded_runs_come_back_and_cost_what_the_models_say(pixels):
    rows = runs.runs(pixels, ["image"])
    train = rows.filter("image < 4")
    got = {(r.image, r.mode): r for r in run_codec.coded(rows, run_codec.fitted(train, rows)).collect()}
    assert len(got) == 12 and all(r.equal and (r.h, r.w) == (HEIGHT, WIDTH) for r in got.values())
    scored = entropy.label_bits(entropy.label_contexts(train, 2), entropy.label_contexts(rows, 2), 2)
    lengths = entropy.length_bits(entropy.length_features(train), entropy.length_features(scored), "label", WIDTH)
    want = {r.image: r for r in lengths.groupBy("image").agg(F.sum("bits_label").alias("a"), F.sum("bits_len").alias("b"), F.count("*").alias("n")).collect()}
    for image, w in want.items():
        r = got[image, "pretrained"]
        assert (r.label_bits, r.ideal_bits, r.n_runs) == (pytest.approx(w.a), pytest.approx(w.a + w.b), w.n)
    for r in got.values():
        assert -1 <= 8 * r.payload_bytes - r.ideal_bits <= 12


def test_growing_counts_pay_where_training_lacks_the_image(pixels):
    rows = runs.runs(pixels, ["image"])
    model = run_codec.fitted(rows.filter("false"), rows)
    got = {(r.image, r.mode): r for r in run_codec.coded(rows, model).collect()}
    assert all(r.equal for r in got.values())
    assert all(got[i, "online"].ideal_bits < got[i, "pretrained"].ideal_bits for i in range(6))


def test_a_file_of_another_model_or_mode_is_an_error():
    model = run_codec.RunModel([0, 1], 4)
    rows = [[(0, 4)], [(1, 1), (0, 3)]]
    data = run_codec.to_file(rows, model, 4, "online")[0]
    assert run_codec.from_file(data, model, "online") == rows
    with pytest.raises(ValueError, match="another mode"):
        run_codec.from_file(data, model, "pretrained")
    model.learn(rows[0])
    with pytest.raises(ValueError, match="model"):
        run_codec.from_file(data, model, "online")
    with pytest.raises(ValueError, match="3 of 4"):
        run_codec.encode([[(0, 3)]], model, 4, False)
    with pytest.raises(ValueError, match="beyond"):
        run_codec.RunModel([0], run_codec.MOST_WIDTH + 1)


def test_one_label_and_one_pixel():
    model = run_codec.RunModel([7], 1)
    assert run_codec.from_file(run_codec.to_file([[(0, 1)]] * 3, model, 1, "online")[0], model, "online") == [[(0, 1)]] * 3


def test_mask_benchmark_is_what_the_libraries_give(pixels, masks):
    got = {(r.image, r.stream, r.codec, r.level): r for r in codecs.mask_benchmark(pixels, ["image"], ("zlib", "zstd"), (1, 6)).collect()}
    assert len(got) == 6 * (3 * 4 + 1)
    for i, m in enumerate(masks):
        left = np.concatenate([m[:, :1], np.diff(m, axis=1)], axis=1).astype(np.uint8)
        pairs = bytearray()
        for line in m:
            cuts = [0, *(np.flatnonzero(np.diff(line)) + 1).tolist(), WIDTH]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pairs += bytes([int(line[a]), b - a])
        for name, data in {"raw": m.astype(np.uint8).tobytes(), "delta_left": left.tobytes(), "rle_row": bytes(pairs)}.items():
            r = got[i, name, "zlib", 6]
            assert (r.bytes_in, r.bytes_out) == (len(data), len(zlib.compress(data, 6)))
            assert r.bbp == pytest.approx(8 * r.bytes_out / m.size)
            assert got[i, name, "zstd", 1].bytes_out == len(zstandard.ZstdCompressor(level=1).compress(data))
        r = got[i, "png_file", "png", None]
        assert r.bytes_in == r.bytes_out == len(png.encode(m.astype(np.uint8)))


def test_tile_benchmark_sums_its_tiles(pixels, masks):
    got = {(r.image, r.stream): r for r in codecs.tile_benchmark(pixels, ["image"], 8, ("zlib",), (6,)).collect()}
    for i, m in enumerate(masks):
        tiles = [m[y : y + 8, x : x + 8].astype(np.uint8) for y in range(0, HEIGHT, 8) for x in range(0, WIDTH, 8)]
        sizes = [len(zlib.compress(t.tobytes(), 6)) for t in tiles]
        own = [8 * n / t.size for n, t in zip(sizes, tiles, strict=True)]
        r = got[i, "raw"]
        assert (r.tiles, r.bytes_in, r.bytes_out) == (6, m.size, sum(sizes))
        assert (r.bbp, r.bbp_mean) == (pytest.approx(8 * sum(sizes) / m.size), pytest.approx(np.mean(own)))
        assert (r.bbp_p50, r.bbp_p90) == (pytest.approx(np.quantile(own, 0.5)), pytest.approx(np.quantile(own, 0.9)))


def test_stream_baselines(spark):
    numbers = [[-1, 2, 300, 70_000, -2], [5] * 50]
    rows = spark.createDataFrame([("a", numbers[0], 9, 5), ("b", numbers[1], None, 0)], "dataset string, numbers array<long>, pixels long, tokens long")
    made = codecs.stream_baselines(rows.withColumn("data", streams.int32_bytes(F.col("numbers"))).drop("numbers"), (6,), (3, 19))
    got = {(r.dataset, r.method, r.level): r for r in made.collect()}
    assert len(got) == 6
    for name, n in zip("ab", numbers, strict=True):
        data = struct.pack(f"<{len(n)}i", *n)
        assert got[name, "lzma", 6].compressed_bytes == len(lzma.compress(data, preset=6))
        assert got[name, "zstd", 19].compressed_bytes == len(zstandard.ZstdCompressor(level=19).compress(data))
    assert got["a", "lzma", 6].bits_per_token == pytest.approx(8 * got["a", "lzma", 6].compressed_bytes / 5)
    assert got["b", "zstd", 3].bits_per_pixel is None and got["b", "zstd", 3].bits_per_token is None
