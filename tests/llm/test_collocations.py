import collections
import random
import re
import string

import numpy as np
import pytest

from staylens.llm import collocations as C

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_count, longest=5, absorbed=100, top=2000):
    total, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = total[lang]
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= absorbed * counts[p[i:j]]}
        scored = []
        for p, a in found.items():
            if p in gone:
                continue
            cuts = [(1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "日", "The", "THE", "ß-x", "a" * 70, "q'", "(b"]
    phrases = [[rng.choice(words) for _ in range(rng.randint(2, 7))] for _ in range(8)]
    rows = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 30)):
            t += rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(words)]
            if rng.random() < 0.2:
                t.append(rng.choice([".", ",", " ; ", "\n", "!?", "\x0b"]))
        rows.append((rng.choice([" ", "  ", "\t"]).join(t), rng.choice(["en", "fr", None, ""])))
    return rows + [(None, "en"), ("", "xx"), ("...", "en"), ("alone", "de"), rows[0], rows[0]]


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "text string, lang string")
    return sorted(map(tuple, C.collocations(docs, **kw).collect()))


@pytest.mark.parametrize("seed,kw", [(0, {"min_count": 5}), (1, {"min_count": 2, "absorbed": 60}), (2, {"min_count": 20, "top": 7}),
                                     (3, {"min_count": 3, "longest": 3}), (4, {"min_count": 4, "longest": 2})])
def test_against_brute_force(spark, seed, kw, monkeypatch):
    monkeypatch.setattr(C, "GATHER_BYTES", 2000)
    monkeypatch.setattr(C, "BUCKET", 300)
    rows = corpus(seed)
    got = run(spark, rows, **kw)
    assert got == brute(rows, **kw) and got


def test_the_query_counts_from_100(spark):
    rows = corpus(9, 1500)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(map(tuple, C.digest(docs).collect()))
    assert got == brute(rows, 100) and got


def test_a_full_map_of_frequent_phrases_changes_nothing(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(C, "_bit_map", lambda rows: np.full(1 << C.LOG_BITS >> 6, ~np.uint64(0)))
    assert run(spark, rows, min_count=5) == brute(rows, 5)


def test_ties_rank_by_count_then_bytes_and_products_pass_64_bits(spark):
    rows = [("é f", "x")] * 4 + [("z y", "x")] * 4 + [("B a", "x")] * 4
    assert [r[2] for r in run(spark, rows, min_count=2)] == ["b a", "z y", "é f"]
    levels = [spark.createDataFrame([("x", p, 10 ** 13) for p in ("a", "b")], "lang string, phrase string, n long"),
              spark.createDataFrame([("x", "a b", 10 ** 13)], "lang string, phrase string, n long")]
    totals = spark.createDataFrame([("x", 3 * 10 ** 13)], "lang string, n long")
    monkey = pytest.MonkeyPatch()
    monkey.setattr(C, "frequent_phrases", lambda *a: (levels, totals))
    try:
        rows = C.collocations(spark.createDataFrame([("a", "x")], "text string, lang string")).collect()
    finally:
        monkey.undo()
    assert rows[0]["score"] == 1000 * 10 ** 13 * 3 * 10 ** 13 // 10 ** 26


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [(None, None)], min_count=1) == []
    docs = spark.createDataFrame([("a b", "en", 1, 2)], "text string, lang string, phrase int, code int")
    assert [tuple(r)[2] for r in C.collocations(docs, min_count=1).collect()] == ["a b"]
    assert C.collocations(docs.limit(0)).collect() == []


@pytest.mark.parametrize("dense", [1, 50, 10 ** 9])
def test_tiles_count_pairs_like_a_table(dense, monkeypatch):
    monkeypatch.setattr(C, "DENSE", dense)
    monkeypatch.setattr(C, "SIDE", 16)
    rng = np.random.default_rng(dense)
    x, y = (np.minimum(rng.zipf(1.4, 5000), 300) - 1 for _ in range(2))
    kind, seen, counts = C.count_pairs(x, y)
    want = collections.Counter(zip(x.tolist(), y.tolist()))
    assert {(x[i], y[i]): n for i, n in zip(seen.tolist(), counts.tolist())} == want and len(seen) == len(want)
    assert (x[seen[kind]] == x).all() and (y[seen[kind]] == y).all()
    rank = C.ranked(kind, counts)
    by_rank = [want[x[i], y[i]] for i in (int(np.flatnonzero(rank == r)[0]) for r in range(len(counts)))]
    assert by_rank == sorted(by_rank, reverse=True)
    assert all(len(a) == 0 for a in C.count_pairs(x[:0], y[:0]))


def test_packed_pairs_add_up_beyond_a_byte():
    import pyarrow as pa

    class Everything:
        value = np.full(1 << C.LOG_BITS >> 6, ~np.uint64(0))
    texts = pa.RecordBatch.from_pydict({"text": ["a b a b " * 500, "c d", "a b"], "lang": ["x", "x", "y"]})
    sent = [pa.Table.from_batches([b]) for b in C._packed_pairs(Everything, 3)(iter([texts]))]
    rows = pa.concat_tables(sent)
    found = {n: sum(C._often(n)(rows.filter(pa.compute.equal(rows["bucket"], b))).num_rows for b in range(3)) for n in (1, 2, 999, 1000, 1001)}
    assert found == {1: 4, 2: 2, 999: 2, 1000: 1, 1001: 0}
