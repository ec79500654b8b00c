"""Parts that run in Python workers, without Spark."""

import numpy as np
import pytest

from bitloom.operators import codecs, ppm
from bitloom.sources import png


def test_arithmetic_coder_round_trip():
    draw = np.random.default_rng(123)
    tables = {b: [0, 1, 40_000, 65_000, codecs.TOTAL] for b in range(-1, 4)}
    for n in (0, 1, 2, 500):
        symbols = draw.integers(0, 4, n).tolist()
        assert codecs.decode_stream(codecs.code_stream(symbols, tables), n, tables) == symbols


def test_container_round_trip():
    for n in (0, 127, 128, 300):
        data = codecs.container(b"h" * n, b"payload")
        assert codecs.split_container(data) == (b"h" * n, b"payload")
    with pytest.raises(ValueError):
        codecs.split_container(codecs.varint(9) + b"short")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(kind):
    draw = np.random.default_rng(5)
    mask = draw.integers(0, np.iinfo(kind).max, (13, 17)).astype(kind)
    back = png.decode(png.encode(mask))
    assert back.dtype == kind and (back == mask).all()


def test_png_reader_modes():
    colour = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    gray = np.repeat(colour[:, :, :1], 3, axis=2)
    assert png.as_mask(colour, "permissive") == (None, "channels differ")
    assert (png.as_mask(gray, "permissive")[0] == gray[:, :, 0]).all()
    assert (png.as_mask(colour, "first_channel")[0] == colour[:, :, 0]).all()
    assert png.as_mask(png.decode(png.encode(colour)), "raw")[0].shape == (2, 3, 3)
    with pytest.raises(ValueError):
        png.as_mask(colour, "strict")


def test_ppm_probabilities_sum_to_one_and_agree_with_mass():
    counts = {(): {0: 3, 1: 2, 4: 1}, (1,): {0: 2, 4: 1}, (0, 1): {4: 1}}
    for history in ((), (1,), (0, 1), (2, 2)):
        p = [ppm.probability(counts, history, 2, s, 6) for s in range(6)]
        assert abs(sum(p) - 1) < 1e-9
        assert abs(ppm.mass_between(counts, history, 2, 1, 4, 6) - sum(p[1:5])) < 1e-9


def test_ppm_scores_of_a_table_are_those_of_its_counts(spark):
    words = {0: [1, 2, 1, 2, 3, 1], 1: [2, 2, 1, 3], 2: [3, 1, 2, 0, 1, 2, 9]}
    rows = spark.createDataFrame([(i, t, s, 0, 4) for i, w in words.items() for t, s in enumerate(w)], "image long, t long, sym long, lo long, hi long")
    train = rows.filter("image < 2")
    counts: dict = {}
    for i in (0, 1):
        for t, s in enumerate(words[i]):
            for k in range(min(2, t) + 1):
                at = counts.setdefault(tuple(words[i][t - k : t]), {})
                at[s] = at.get(s, 0) + 1
    got = {(r.image, r.t): (r.p, r.z) for r in ppm.score(train, rows, 2, 6, ["image"], ["t"]).collect()}
    assert len(got) == 17
    for (i, t), (p, z) in got.items():
        history = tuple(words[i][max(0, t - 2) : t])
        assert abs(p - ppm.probability(counts, history, 2, words[i][t], 6)) < 1e-12
        assert abs(z - ppm.mass_between(counts, history, 2, 0, 4, 6)) < 1e-12
