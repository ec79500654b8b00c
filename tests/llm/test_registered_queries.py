"""The registered queries on a small corpus with nulls, empty, long and repeated texts, ties and clashing column names, against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import pii, quality, queries, topk
from bitloom.llm.common import Workspace

public = pytest.importorskip("public_tokenizers")

#: Names that the operators use themselves, as columns of the table.
EXTRA = ["score", "secrets", "ratio", "n_words", "packed", "chunks", "copies", "node", "bucket", "__text", "__score", "c0", "spans", "row", "term", "h"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of_corpus():
    draw = np.random.default_rng(9)
    words = ["".join(chr(97 + int(c)) for c in draw.integers(0, 26, int(draw.integers(2, 9)))) for _ in range(700)]
    say = lambda n: " ".join(words[int(i)] for i in draw.integers(0, 700, n))
    texts = [(i, say(int(draw.integers(60, 160)))) for i in range(150)]
    texts += [(200 + i, say(60) + " vequixol " + say(20) + " vequixol scumbrag " + say(10)) for i in range(60)]  # the toxic ones
    texts += [(300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "é 日本 a#b"), (305, texts[0][1]), (306, texts[0][1] + " tail"), (305, texts[0][1])]
    texts += [(310, "line again here\n" * 80), (311, "x" * 5000), (312, say(9000)), (None, "no id " + say(50))]
    texts += [(320, 'my Password = "hunter2222" and token:abc and secret: zzzzzz\nAKIA' + "A" * 16 + " " + "0af" * 10 + " é AKIAé"), (321, "ghp_" + "a1" * 20 + " " + "0" * 23)]
    texts += [(330 + i, f"ask Quibblesnatch at ann{i}@mail.example.org or 10.0.{i}.999 or 10.0.0.{i} or 4111 1111 1111 1111 or +1 (555) 010-999{i}") for i in range(3)]
    return [(i, t, ["en", "de", None][k % 3], f"src{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rows = rows_of_corpus()
    spark.createDataFrame([(*r, *("x" for _ in EXTRA)) for r in rows], SHAPE).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 260)) for i, *_ in rows if i is not None and i < 260] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SHAPE).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_op1_finds_held_out_texts(spark, corpus):
    root, rows = corpus
    got = queries.op1_toxicity(spark, root).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert {r.predicted for r in got if r.held_out and 200 <= r.doc_id < 260} == {1}
    assert {r.predicted for r in got if r.held_out and r.doc_id < 150} == {0}
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert len(by[305]) == 1 and by[300] == by[301]


def brute_topk(rows, k=5):
    held = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows]
    found = collections.defaultdict(list)
    for i, x in held:
        if i % 50 == 0:
            found[i] += [(-sum(a * b for a, b in zip(x, y)), j) for j, y in held if j != i]
    near = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    return sorted((i, n, j, near(-s)) for i, some in found.items() for n, (s, j) in enumerate(sorted(some)[:k], 1))


def test_op2_repeated_ids_long_and_huge_vectors(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.choice([0.0, 1.0, 2.0**33, -(2.0**33), 0.5], int(draw.integers(0, 6)))]) for i in range(120)]
    rows += [(50, [1.0]), (7, [5.0]), (7, [3.0]), (100, [1e300, 1.0]), (3, [1e300, -1.0]), (9, [1.0] * 5000), (150, [1.0] * 5000)]
    spark.createDataFrame([*rows, (None, [1.0]), (4, None), (4, [None]), (4, [float("inf")])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op2_exact_topk(spark, str(tmp_path)).collect())
    assert got == brute_topk(rows)


def test_op2_sends_chunks_only_to_segments_their_bounds_reach(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.eye(8)[i // 128 % 8] * 4 + draw.normal(0, 0.1, 8)]) for i in range(2048)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, met = topk.meetings(vectors, F.col("id") % 50 == 0, Workspace(spark, "pruned"), 5, "vec_id", "embedding", 256.0, 16, 64, 4)
    assert sorted(tuple(r) for r in topk.ranked(found, 5).collect()) == brute_topk(rows)
    assert met.count() < 11 * 32 / 2  # 41 queries in chunks of 4, 32 segments and more
    assert found.agg(F.max("scored")).first()[0] <= 4


def test_op3_covers_every_id_once(spark, corpus):
    from tokenizers import Tokenizer

    root, rows = corpus
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    got = queries.op3_packing(spark, root).collect()
    want = collections.Counter()
    whole = {}
    for i, t, *_ in rows:
        whole[i] = np.array(ids[i, t], "<u4")
        want[i] += len(whole[i])
    have, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        have[r.doc_id] += r.length
        assert r.doc_tokens == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048


def plain_statistics(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j + n for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for n in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_op5_equals_a_plain_version(spark, corpus):
    import zstandard

    root, rows = corpus
    size = lambda x: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x))
    bands, number = quality.Bands(), lambda n: math.floor(math.log2(n) * quality.RANGES + 1e-9)
    parts = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        cut = [b[k : k + quality.CHUNK] for k in range(0, len(b), quality.CHUNK)]
        parts[i, t] = [(len(x), size(x)) for x in ([b] if b else []) + (cut if len(cut) > 1 else [])]
    counts = collections.defaultdict(collections.Counter)
    for n, p in {x for some in parts.values() for x in some}:
        counts[number(n)][round(p * 1000 / n) / 1000] += 1
    limits = quality.limits_of({k: list(c.items()) for k, c in counts.items()}, bands)
    inside = lambda n, p: limits[number(n)][0] <= p / n <= limits[number(n)][1]
    want = []
    for i, t, *_ in rows:
        words, chars, symbols, lines, again = plain_statistics(t or "")
        failed = words < 50 or 100 * again > 50 * words
        some = parts[i, t]
        bad = sum(n for n, p in (some[1:] or some) if not inside(n, p))
        kept = not failed and all(inside(*x) for x in some[:1]) and bad <= bands.chunk_share * sum(n for n, _ in some[:1])
        want.append((i or -1, words, chars, symbols, lines, again, failed, kept))
    got = queries.op5_quality(spark, root)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((r.doc_id or -1, *(r[c] for c in names)) for r in got.collect()) == sorted(want)


def test_op5_limits_reject_padded_prose(spark):
    draw = np.random.default_rng(2)
    words = ["".join(chr(97 + int(c)) for c in draw.integers(0, 26, int(draw.integers(2, 9)))) for _ in range(900)]
    say = lambda n: [words[int(i)] for i in draw.integers(0, 900, n)]
    texts = [(i, " ".join(say(450))[: 1900 + i % 100]) for i in range(1500)]
    texts += [(9000, " ".join(f"{w} |" for w in say(450))[:1950]), (9001, "".join(f"{w}%%% " for w in say(450))[:1950])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.band_kept for r in quality.judge(docs).collect()}
    assert not got[9000] and not got[9001] and sum(not got[i] for i in range(1500)) <= 3


def test_op7_counts_like_the_library_and_again_from_its_cache(spark, corpus):
    from tokenizers import Tokenizer

    root, rows = corpus
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sorted((i or -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in rows)
    for _ in range(2):
        got = queries.op7_token_counts(spark, root).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op9_equals_plain_expressions(spark, corpus):
    root, rows = corpus
    want = []
    for i, t, *_ in rows:
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t or "") if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        base = [(k, a, b) for a, _, k, b in sorted(found)]
        want.append((i or -1, *(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")), digest(base)))
    got = queries.op9_secrets(spark, root).collect()
    assert sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    text = {i: t for i, t, *_ in rows}
    spans = {r.doc_id: [(k, text[r.doc_id][int(a) : int(b)]) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in got if r.doc_id in (320, 321)}
    assert spans == {320: [("assign", 'Password = "hunter2222'), ("assign", "secret: zzzzzz"), ("access", "AKIA" + "A" * 16), ("hex", "0af" * 10)], 321: [("github", "ghp_" + "a1" * 20), ("hex", "a1" * 20)]}


ADDED = {
    "github_pat": "github_pat_" + "A1b2" * 20, "gitlab": "glpat-" + "aB3_" * 6, "slack": "xoxb-1234567890-abcdefghij", "stripe": "sk_live_" + "aB3" * 8,
    "google": "AIza" + "Sy_a9" * 7, "npm": "npm_" + "a1B2" * 9, "sendgrid": "SG." + "aB3_" * 5 + "." + "xY9-" * 8, "jwt": "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc-DEF_123",
    "url_login": "://user:s3cr.t!@", "bearer": "Authorization: Bearer abcdefghij.KLMNOPQRST",
}


def test_op9_added_rules_in_one_text(spark):
    text = "é " + " — ".join(ADDED.values()) + " end"
    from bitloom.llm import secret_scan

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {s["kind"]: text[s["start"] : s["end"]] for s in secret_scan.scan(docs).first().secrets}
    assert {k: v for k, v in got.items() if k in ADDED} == ADDED


def plain_pii(text):
    mail = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            card.append(("card", *m.span()))
    phone = [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [*mail, *ip, *card, *phone]


def plain_disclosing(rows):
    """The added spans of each row, from the formula, with plain loops."""
    s, total = pii.Settings(), len(rows)
    base = [plain_pii(t or "") for _, t, *_ in rows]
    key = lambda t, k, a, b: (k, re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower())
    held = collections.defaultdict(set)
    for n, (row, spans) in enumerate(zip(rows, base)):
        for span in spans:
            held[key(row[1], *span)].add(n)
    in_doc, terms = collections.Counter(), {}
    for n, (_, t, *_) in enumerate(rows):
        found = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")]
        in_doc.update({t[a:b].lower() for a, b in found})
        cut = []
        for a, b in found:
            a = max([a, *(e for _, x, e in base[n] if x <= a)])
            b = min([b, *(x for _, x, _ in base[n] if x >= a)])
            if b - a >= 3:
                cut.append((a, b, t[a:b].lower()))
        terms[n] = cut
    added = [[] for _ in rows]
    for e, docs in held.items():
        part = len(docs) / total
        both = collections.Counter(w for n in docs for w in {w for _, _, w in terms[n]})
        for w, c in both.items():
            share = math.log2((c + s.prior * part) / ((max(in_doc[w], c) + s.prior) * part)) / math.log2(1 / part)
            if share >= s.generalise:
                kind = "remove" if share >= s.remove else "generalise"
                for n in docs:
                    added[n] += [(kind, a, b) for a, b, x in terms[n] if x == w]
    strong = []
    for some in added:
        best = {}
        for k, a, b in some:
            best[a, b] = max(best.get((a, b), ""), k)
        strong.append(sorted((k, a, b) for (a, b), k in best.items()))
    return base, strong


def test_op10_equals_a_plain_version(spark, corpus):
    root, rows = corpus
    base, strong = plain_disclosing(rows)
    kinds = ("email", "ip", "card", "phone")
    want = []
    for (i, *_), spans, more in zip(rows, base, strong):
        every = [*spans, *sorted(more, key=lambda x: (x[0] == "remove", x[1]))]
        want.append((i or -1, *(sum(k == x for k, _, _ in spans) for x in kinds), digest(spans), ",".join(f"{k}:{a}:{b}" for k, a, b in every)))
    got = queries.op10_pii(spark, root).collect()
    assert sorted((r.doc_id or -1, *(r[f"n_{k}"] for k in kinds), r.base_sha256, r.spans) for r in got) == sorted(want)
    assert any(more for more in strong)
