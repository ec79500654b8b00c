"""The Python kernels of the corpus operators against plain versions."""

import collections
import re

import numpy as np
import pytest

from bitloom.llm import automaton, minhash, packing, quality, secret_scan, topk, toxicity, wordcache

public = pytest.importorskip("public_tokenizers")

TEXTS = ["", " \n ", "a", "it's we're DON'T 12 345 ...!!", "foo  <|endoftext|> bar", "a  b \n\nc   d\t\te \n", "İΣς ΑΣ", "é ́x", "\x1c a\x1db", "日本 語 テスト", "x" * 300 + "  \r\n y", "foo \n\nbar   z"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_cache_gives_the_library_ids(name):
    cache = wordcache.WordCache(public.path(name), memory=3)
    for text in TEXTS + TEXTS[::-1]:
        want = cache.tokenizer.encode(text, add_special_tokens=False).ids
        assert cache.ids(text.encode()).tolist() == want
        assert cache.count(text.encode()) == len(want)


def test_best_fit_takes_the_tightest_window():
    lengths = sorted(np.random.default_rng(1).integers(1, 20, 200).tolist(), reverse=True)
    names, offsets = packing.best_fit(lengths, 20)
    room: dict[int, int] = {}
    for length, name, offset in zip(lengths, names, offsets):
        fits = [r for r in room.values() if r >= length]
        if fits:
            assert room[name] == min(fits) and offset == 20 - room[name]
        else:
            assert name not in room and offset == 0
        room[name] = room.get(name, 20) - length


@pytest.mark.parametrize("pattern", ["ab+c|b", "[a-c]{2,3}x?", "(?i:ab)|(c.)*a", "a{2}[^b\\x20]"])
def test_automata_match_like_regular_expressions(pattern):
    draw = np.random.default_rng(7)
    rule = secret_scan.Rule("k", pattern)
    scanner = secret_scan.Scanner((rule,))
    plain = re.compile(pattern.encode())
    for _ in range(300):
        data = bytes(draw.choice(list(b"abcxAB \n"), int(draw.integers(0, 12))).astype(np.uint8))
        want, at = [], 0
        while at < len(data):  # leftmost, then longest
            ends = [e for e in range(len(data), at, -1) if plain.fullmatch(data, at, e)]
            if ends:
                want.append((at, ends[0]))
                at = ends[0]
            else:
                at += 1
        got = [x for x in scanner.matches(rule, data) if x[0] < x[1]]
        assert got == want, (pattern, data)
        assert scanner._backwards(0, data) == want


def test_secret_spans_in_code_points_and_redaction():
    text = "é Password = 'hunter22x' secret=token:abcdefgh AKIA" + "A" * 16 + " " + "0a" * 12
    data = text.encode()
    spans = secret_scan.Scanner().spans(data)
    assert [(k, text[a:b]) for a, b, k in secret_scan.code_points(data, spans)] == [("assign", "Password = 'hunter22x"), ("access", "AKIA" + "A" * 16), ("hex", "0a" * 12)]
    assert secret_scan.redacted(data, spans).decode() == "é [ASSIGN]' secret=token:abcdefgh [ACCESS] [HEX]"


def test_quality_statistics():
    text = "a b c\na b c\n\n x# é y\n"
    words = text.split()
    assert quality.statistics(text.encode()) == (len(words), sum(map(len, words)), 1, 1, 6)
    assert quality.statistics(b"") == (0, 0, 0, 0, 0)
    draw = np.random.default_rng(3)
    words = [bytes([97 + int(i)]) for i in draw.integers(0, 3, 60)]
    count = collections.Counter(zip(words, words[1:], words[2:]))
    cover = {j + i for j, w in enumerate(zip(words, words[1:], words[2:])) if count[w] > 1 for i in range(3)}
    assert quality.repeated_words(words) == len(cover)


def test_shingles_of_short_and_empty_texts():
    of = minhash.Sketcher(minhash.Settings(words=4))
    assert [len(of.shingles(t)) for t in (b"", b" \t", b"a", b"a b c", b"a b c d", b"a b c d e", b"a a a a a a")] == [0, 0, 1, 1, 1, 2, 1]
    assert (of.shingles(b"A b\x0bC d") == of.shingles(b"a b c d")).all()


def test_topk_visit_matches_brute_force():
    draw = np.random.default_rng(11)
    data = draw.integers(-5, 6, (200, 7))
    ids = np.arange(200) * 3
    for q, names, scores, scored in topk.visit(data[:20], ids[:20], np.full(20, -np.inf), ids, data, 16, 5):
        score = data @ data[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:5]
        assert names.tolist() == ids[order].tolist() and scores.tolist() == score[order].tolist()


def test_grams_are_the_same_in_pieces(monkeypatch):
    settings = toxicity.Settings(bits=12)
    text = "abcdefghij klmnop" * 5
    whole = [x.tolist() for x in toxicity.values(text, settings)]
    monkeypatch.setattr(toxicity, "_CHUNK", 16)
    assert [x.tolist() for x in toxicity.values(text, settings)] == whole


def test_expression_errors():
    with pytest.raises(ValueError):
        automaton.Parser("(a").parse()
