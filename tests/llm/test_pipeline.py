"""Each stage of corpus_pipeline.py on a small corpus against a plain version, on what the stage before kept."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import mixing, queries, secret_scan

from .test_registered_queries import EXTRA, SHAPE, corpus, empty  # noqa: F401

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, corpus):  # noqa: F811
    root, rows = corpus
    made = [*rows, (400, " ".join([*rows[1][1].split(), "more"]), "en", "src1", 5), (401, rows[2][1], "de", None, 6)]
    return root, made, spark.createDataFrame([(*r, *("x" for _ in EXTRA)) for r in made], SHAPE)


def test_stages_keep_the_columns(spark, docs):
    root, _, table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, root).columns == table.columns, name


def test_toxicity_stage(spark, docs):
    root, rows, table = docs
    got = collections.Counter(r.doc_id for r in corpus_pipeline.drop_toxic(spark, table, root).collect())
    assert got == collections.Counter(i for i, *_ in rows if i is None or not 200 <= i < 260)


def test_near_duplicate_stage(spark, docs):
    root, rows, table = docs
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    find = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                    find[a] = find[b] = min(find[a], find[b])
    want = collections.Counter(i for i, *_ in rows if i is None or find[i] == i)
    got = collections.Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, root).collect())
    assert got == want and find[305] == 0 and find[400] == 1 and find[401] == 2


def test_secret_stage(spark, docs):
    root, rows, table = docs
    scanner = secret_scan.Scanner()
    want = []
    for i, t, *_ in rows:
        made, at = "", 0
        for a, b, kind in secret_scan.code_points((t or "").encode(), scanner.spans((t or "").encode())):
            if a >= at:
                made += (t or "")[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        want.append((i or -1, None if t is None else made + t[at:]))
    got = corpus_pipeline.redact_secrets(spark, table, root).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i, t or "") for i, t in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert not any("hunter2222" in (r.text or "") for r in got)


def plain_shares(nodes, budget):
    """[(name, weight, capacity)] to budgets: those that their share fills first, the rest by weight in whole numbers."""
    out, left, weights = {}, budget, sum(w for _, w, _ in nodes)
    for at, (name, w, capacity) in enumerate(sorted(nodes, key=lambda x: (x[2] / x[1], x[0]))):
        if capacity * weights <= w * left:
            out[name], left, weights = capacity, left - capacity, weights - w
        else:
            for rest, v, c in sorted(nodes, key=lambda x: (x[2] / x[1], x[0]))[at:]:
                out[rest] = min(c, v * max(left, 0) // weights)
            break
    return out


def test_mixing_stage(spark, docs):
    from tokenizers import Tokenizer

    root, rows, table = docs
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    leaves = collections.defaultdict(list)
    for i, t, lang, source, _ in rows:
        number = int(source[3:]) if source else 0
        leaves[f"d{number % 3}", lang or "", source or ""].append((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1))
    sums = {leaf: sum(n for _, n in some) for leaf, some in leaves.items()}
    level = {(): int(sum(sums.values()) * corpus_pipeline.MIXED)}
    for depth, name in enumerate(queries.TREE, 1):
        below = collections.defaultdict(collections.Counter)
        for leaf, n in sums.items():
            below[leaf[: depth - 1]][leaf[depth - 1]] += n
        level = {(*up, k): b for up, budget in level.items() for k, b in plain_shares([(k, queries.WEIGHTS.get(name, {}).get(k, 1), c) for k, c in below[up].items()], budget).items()}
    want = collections.Counter()
    for leaf, some in leaves.items():
        import hashlib

        if sums[leaf] and level[leaf] >= sums[leaf]:
            want.update(i for i, _ in some)
            continue
        by = collections.defaultdict(list)
        for i, n in some:
            by[hashlib.md5(f"7:0:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        spent = 0
        for key in sorted(by):
            spent += sum(n for _, n in by[key])
            if spent > level[leaf]:
                break
            want.update(i for i, _ in by[key])
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, table, root).collect())
    assert got == want and 0 < sum(want.values()) < len(rows)


def test_packing_stage_and_the_whole_run(spark, corpus, empty):  # noqa: F811
    from tokenizers import Tokenizer

    root, rows = corpus
    got = corpus_pipeline.run(spark, root).collect()
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    scanner = secret_scan.Scanner()
    clean = {i: secret_scan.redacted((t or "").encode(), scanner.spans((t or "").encode())).decode() for i, t, *_ in rows}
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        places[r.sequence_id].append((r.offset, r.length))
    for i, some in pieces.items():
        assert sum((ids for _, ids in sorted(some)), []) == [*library.encode(clean[i], add_special_tokens=False).ids, 1]
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    assert not any(200 <= (i or 0) < 260 or i in (305, 306) for i in pieces)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_weights_below_one_count_as_one(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "doc_id long, domain string, n_tokens long")
    assert mixing.mix(rows, ["domain"], {"domain": F.lit(0)}, F.lit(20), epochs=1).count() == 2
