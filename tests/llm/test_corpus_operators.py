"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import minhash, mixing, packing, pii, quality, secret_scan, tokencount, topk, toxicity, url_filter

public = pytest.importorskip("public_tokenizers")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, bucket long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", 0, 0.0, 0, 0) for i, t in texts], SHAPE)


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)


@pytest.mark.parametrize("block_rows", [1000, 4])
def test_minhash_links_like_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(minhash, "_BLOCK_ROWS", block_rows)  # small blocks: families go on across blocks
    draw = np.random.default_rng(2)
    base = [WORDS[int(i)] for i in draw.integers(0, 400, 120)]
    texts = [None, "", " \n", "a b", "a b", "A  B", LONG, LONG, LONG + " end"]
    for k in range(25):  # near copies at and around the limit
        words = list(base)
        for at in draw.choice(120, k % 7, replace=False):
            words[int(at)] = f"x{int(draw.integers(0, 99))}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts, 5)) + [(5 + len(texts) - 1, texts[-1])]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    find = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and both * 100 >= 80 * len(sets[a] | sets[b]):
                    find[a] = find[b] = min(find[a], find[b])
    got = minhash.cluster(documents(spark, rows), minhash.Settings(words=4)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), find[i], find[i] == i) for i in sets}


def test_minhash_of_a_long_chain_goes_by_buckets(spark, monkeypatch):
    """Texts that share much with the next one only: a family of many blocks, whose grid would ship more than its buckets."""
    monkeypatch.setattr(minhash, "_BLOCK_ROWS", 3)
    names = []
    compare = minhash.compare
    monkeypatch.setattr(minhash, "compare", lambda *a: names.append(a[4]) or compare(*a))
    stream = [f"t{i}" for i in range(2400)]
    texts = [" ".join(stream[at : at + 100]) for at in range(0, 2280, 12)]  # neighbours at 0.78 in shingles of four, below the limit
    texts += [texts[i] + " end" for i in range(0, len(texts), 9)]
    texts += [" ".join(["one"] * 3 + stream[:100] + [f"z{i}"]) for i in range(12)]  # a bucket wider than a block
    rows = list(enumerate(texts))
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    find = {i: i for i in sets}

    def top(x):
        while find[x] != x:
            x = find[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                one, two = sorted((top(a), top(b)))
                find[two] = one
    got = minhash.cluster(documents(spark, rows), minhash.Settings(words=4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}
    assert names == ["within", "across", "buckets", "wide"]


def test_minhash_of_an_empty_table(spark):
    assert minhash.cluster(documents(spark, []).limit(0)).count() == 0


def test_toxicity_learns_and_scores_empty_texts(spark):
    bad = [(i, f"some calm words {i} and a vequix word" if i % 3 == 0 else f"some calm words {i} and a plain word") for i in range(60)]
    docs = documents(spark, [*bad, (99, None), (98, "")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in bad] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 40)
    got = {r.doc_id: r.score for r in toxicity.classify(docs, model).collect()}
    assert len(got) == 62 and got[98] == got[99]
    assert min(got[i] for i in range(40, 60) if i % 3 == 0) > 0.3 > max(got[i] for i in range(40, 60) if i % 3)
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score < 1e-6 for r in toxicity.classify(docs, one, keep=["doc_id"]).collect()} == {True}


def test_topk_ties_nulls_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0]), (6, []), (7, [-1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(vectors, F.col("id") == 0, k=3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 65536), (2, 2, 65536), (3, 2, 65536)]  # a repeated row is a candidate too
    assert topk.search(vectors.limit(0), F.col("id") == 0).count() == 0


def test_packing_covers_every_token_once(spark):
    texts = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, "hello world")]
    cut = packing.pieces(documents(spark, texts), public.path("word_bpe_49k.json"), window=64)
    rows = packing.pack(cut.drop("ids"), window=64).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * max(r.doc_tokens for r in rows if r.doc_id == 3)
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_quality_keeps_clean_and_drops_repeats(spark):
    texts = [(1, None), (2, " ".join(f"{a}{b}" for a, b in zip(WORDS, WORDS[::-1]))), (3, "same line again\n" * 400)]
    got = {r.doc_id: (r.n_words, r.band_kept) for r in quality.judge(documents(spark, texts), keep=["doc_id", "node"]).collect()}
    assert got == {1: (0, True), 2: (400, True), 3: (1200, False)}


def test_quality_drops_base64(spark):
    draw = np.random.default_rng(4)
    prose = lambda n: " ".join(WORDS[i] + WORDS[j] for i, j in draw.integers(0, 400, (n, 2)))[:n]
    dump = lambda n: "\n".join(base64.b64encode(draw.bytes(48)).decode() for _ in range(n // 65 + 1))[:n]
    texts = [(i, dump(n)) for i, n in enumerate((300, 400, 600, 900, 1500, 3000, 5000, 20000))]
    texts += [(20, prose(6000)), (21, prose(4096) + dump(2000)), (22, prose(4096) + dump(200)), (23, prose(4096) + dump(8192))]
    got = {r.doc_id: (r.band_kept, r.n_chunks, r.n_bad_chunks) for r in quality.judge(documents(spark, texts), keep=["doc_id"]).collect()}
    assert [got[i][0] for i in range(8)] == [False] * 8
    assert [got[i] for i in range(20, 24)] == [(True, 2, 0), (False, 2, 1), (True, 2, 0), (False, 3, 2)]


def test_token_cache_encodes_only_misses(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), public.path("byte_bpe_50k.json")
    docs = documents(spark, [(1, None), (2, ""), (3, "hello world"), (4, "hello world"), (4, "hello world")])
    first = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count(docs, path, cache).collect())
    assert first == [(1, 0, 0), (2, 0, 0), (3, 11, 2), (4, 11, 2), (4, 11, 2)]
    assert spark.read.parquet(cache).count() == 2
    assert tokencount.count(docs.unionByName(documents(spark, [(5, "new")])), path, cache).count() == 6
    assert spark.read.parquet(cache).count() == 3


def test_mixing_redistributes_shortages_to_siblings_first(spark):
    rows = spark.createDataFrame([(i, d, l, 10) for i, (d, l) in enumerate([("a", "x")] * 2 + [("a", "y")] * 20 + [("b", "z")] * 50)], "doc_id long, domain string, lang string, n_tokens long")
    got = mixing.mix(rows, ["domain", "lang"], {}, F.lit(200), epochs=1).groupBy("domain", "lang").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()
    assert {(r.domain, r.lang): r.t for r in got} == {("a", "x"): 20, ("a", "y"): 80, ("b", "z"): 100}
    again = mixing.mix(rows.filter("lang = 'x'"), ["domain", "lang"], {}, F.lit(10_000), epochs=3)
    assert [r.copies for r in again.collect()] == [3, 3]
    assert mixing.mix(rows.limit(0), ["domain", "lang"], {}, F.lit(5)).count() == 0


def test_secrets_pass_other_columns_and_nulls(spark):
    docs = documents(spark, [(1, None), (2, "token = abcdef123"), (3, "clean")])
    got = {r.doc_id: (r.text, len(r.secrets)) for r in secret_scan.scan(docs, redact=True).collect()}
    assert got == {1: (None, 0), 2: ("[ASSIGN]", 1), 3: ("clean", 0)}


def test_private_keys_are_redacted_with_their_bodies(spark):
    body = [base64.b64encode(bytes((i * k) % 256 for i in range(48))).decode() for k in range(3, 9)] + ["Ab3x"]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n"
    key = "\n".join([begin, *body, end])
    texts = {
        1: (f"a {key} b", "a [PRIVATE_KEY] b"),
        2: (f"a\n{key}\n{key}\nsaid so", "a\n[PRIVATE_KEY]\n[PRIVATE_KEY]\nsaid so"),
        3: (key.replace("\n", "\\n") + '"}', '[PRIVATE_KEY]"}'),
        4: (key.replace("\n", "\r\n"), "[PRIVATE_KEY]"),
        5: (key.replace("\n", " "), "[PRIVATE_KEY]"),
        6: (f"{begin}\n{head}\n" + "\n".join([*body, end]), "[PRIVATE_KEY]"),
        7: (f"{begin}\n" + "\n".join(body), "[PRIVATE_KEY]"),
        8: (f"{begin}\n{head}\n" + "\n".join(body[:-1]) + "\n\n- more words", "[PRIVATE_KEY]\n\n- more words"),
        9: (f"the line {begin} is how it begins, é", "the line [PRIVATE_KEY] is how it begins, é"),
    }
    got = {r.doc_id: r.text for r in secret_scan.scan(documents(spark, [(i, t) for i, (t, _) in texts.items()]), redact=True).collect()}
    assert got == {i: want for i, (_, want) in texts.items()}


def test_personal_data_spans_and_disclosing_terms(spark):
    texts = [(i, f"notes by Zanzibar for ann{i % 2}@mail.example.org today") for i in range(8)] + [(i, f"plain words {i}") for i in range(8, 60)]
    texts += [(60, None), (61, "é 4111 1111 1111 1111, 1.2.3.4 and +1 (555) 010-9999; 999.1.1.1 a@b.c%d@e.f")]
    found = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in pii.find(documents(spark, texts)).collect()}
    assert found[60] == [] and len(found) == 62
    text = texts[-1][1]
    mails = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [text[a:b] for _, a, b in mails] == ["a@b.c", "%d@e.f"]
    assert found[61] == [*mails, ("ip", 23, 30), ("card", 2, 21), ("phone", 35, 52)]
    kinds = {k for k, _, _ in found[0]}
    assert "email" in kinds and kinds & set(pii.ACTIONS)
    assert found[8] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(spark, texts)).collect()}
    assert "@mail" not in clean[0] and clean[60] is None and clean[8] == "plain words 8"


def test_entities_of_one_or_two_documents_have_disclosing_terms(spark):
    texts = [(0, "call Quibblesnatch at one@mail.example.org with words"), *((i, "ask Dromedarius at two@mail.example.org with words") for i in (1, 2))]
    texts += [(i, f"plain words with number {i} at call ask") for i in range(3, 400)]
    spans = {r.doc_id: {texts[r.doc_id][1][s["start"] : s["end"]]: s["kind"] for s in r.spans} for r in pii.find(documents(spark, texts)).collect()}
    assert spans[0] == {"one@mail.example.org": "email", "Quibblesnatch": "generalise"}
    assert spans[1] == spans[2] == {"two@mail.example.org": "email", "Dromedarius": "generalise"}
    assert spans[3] == {}


def test_disclosing_terms_are_marked_in_the_whole_document(spark):
    filler = " ".join(f"plain words {i}" for i in range(60))
    far = f"Quibblesnatch wrote. {filler} ask one@mail.example.org, +1 (555) 010-9999 quibblesnatch {filler} QUIBBLESNATCH éann@x.org"
    texts = [(0, far), (1, far), *((i, f"plain words with number {i} wrote ask") for i in range(2, 400))]
    found = {r.doc_id: [(far[s["start"] : s["end"]], s["kind"]) for s in r.spans] for r in pii.find(documents(spark, texts)).collect() if r.doc_id < 2}
    assert found[0] == found[1] == [("one@mail.example.org", "email"), ("ann@x.org", "email"), ("+1 (555) 010-9999", "phone"), *((w, "generalise") for w in ("Quibblesnatch", "quibblesnatch", "QUIBBLESNATCH"))]


def test_url_lists_as_of_the_fetch_day(spark):
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    urls = [(1, "http://a.example.com/x/y", 10), (2, "http://a.example.com/x/y", 200), (3, "HTTPS://User@B.example.com:80/?q", 10), (4, None, 10), (5, "not a url", 10), (6, "http://a.example.com/z", 400), (7, "http://a.example.com/", None)]
    captures = spark.createDataFrame(urls, "page_id long, url string, n long").select("page_id", "url", day(F.col("n")).alias("fetched"))
    entries = spark.createDataFrame([("domain", "example.com", "block", 0), ("host", "a.example.com", "allow", 100), ("host", "a.example.com", "remove", 300), ("prefix", "a.example.com/x", "block", 150), ("host", None, "block", 0)], "kind string, pattern string, action string, n long").select("kind", "pattern", "action", day(F.col("n")).alias("listed"))
    got = {r.page_id: (r.verdict, r.n_active) for r in url_filter.judge(captures, entries).collect()}
    assert got == {1: ("block", 1), 2: ("block", 3), 3: ("block", 1), 4: ("keep", 0), 5: ("keep", 0), 6: ("block", 1), 7: ("keep", 0)}
