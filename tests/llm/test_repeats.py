import collections
import hashlib
import random
import re

import numpy as np
import pytest

from staylens.llm import repeats as R
from staylens.llm import textcodes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """(words, which of them go) of each text, by counting every window's words."""
    docs = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((w, gone))
    return out


def expected(rows, window):
    return sorted(((k, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for (k, _), (w, g) in zip(rows, brute([t for _, t in rows], window))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice([3, 60, 2000]))] + ["é", "日本", "A", "a", "x" * 80, "x" * 79 + "y"]
    passages = [[rng.choice(words) for _ in range(rng.choice([4, 12, 34, 35, 36, 90]))] for _ in range(6)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(rng.randint(0, 6)):
            t += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "\n", " \t\r\n"]).join(t)))
    return rows + [(100, None), (101, ""), (102, " \n"), (None, rows[3][1]), (None, None), rows[5], rows[5], (103, "ab " * 300), (104, "ab " * 34)]


def run(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, name = R.remove_repeats(docs, window=window)
    return sorted(((r["doc_id"], *r[name]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed,window", [(0, 35), (1, 35), (2, 35), (3, 2), (4, 5), (5, 1)])
def test_against_brute_force(spark, seed, window, monkeypatch):
    monkeypatch.setattr(R, "SHARD_BYTES", 3000)
    monkeypatch.setattr(R, "BUCKET_BYTES", 5000)
    rows = corpus(seed)
    assert run(spark, rows, window) == expected(rows, window)


def test_digest_hashes_the_kept_words(spark):
    rows = corpus(7)
    got = sorted(map(tuple, R.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted(((k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in expected(rows, 35)), key=repr)


def test_a_long_text_is_one_shard_and_its_repeats_are_found(spark):
    rng = random.Random(1)
    long = " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(700_000))         # over SHARD_BYTES
    inside = " ".join(long.split(" ")[300_000:300_050])
    rows = [(1, long), (2, "before " + inside + " after"), (3, "nothing here")]
    got = {r[0]: r[1:3] for r in run(spark, rows, 35)}
    assert got == {1: (700_000, 50), 2: (52, 50), 3: (2, 0)}


def test_columns_stay_and_an_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([(1, "a b", {"x": 1.5}, "q"), (2, None, None, None)], "`doc.id` long, text string, m map<string,double>, repeats string")
    found, name = R.remove_repeats(docs, window=2)
    assert name == "repeats_" and found.columns == [*docs.columns, name]
    assert sorted((r[0], r[2], r[3], r[4]["kept"]) for r in found.collect()) == [(1, {"x": 1.5}, "q", "a b"), (2, None, None, "")]
    empty, _ = R.remove_repeats(docs.limit(0))
    assert empty.collect() == []


def test_passages_are_located_through_automata_of_any_size(monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[50:300]), " ".join(base[10:20]), "", " ".join(base[200:400] + base[:150]), "z " * 200]
    window = 6
    want = brute(texts, window)
    import pyarrow as pa
    data, offsets = textcodes.joined(pa.array(texts))
    starts, ends = textcodes.spans(data, textcodes.NOT_SPACE)
    first = np.searchsorted(starts, offsets)
    words, offs = textcodes.gather(data, starts, ends)
    seen = collections.Counter(tuple(w[i:i + window]) for w, _ in want for i in range(len(w) - window + 1))
    recurs = np.zeros(len(starts) - window + 1, bool)
    for (w, _), a in zip(want, first.tolist()):
        for i in range(len(w) - window + 1):
            recurs[a + i] = seen[tuple(w[i:i + window])] > 1
    for size, cut in ((1 << 20, 1 << 20), (300, 1 << 20), (100, 7), (1, 1)):
        monkeypatch.setattr(R, "PATTERN_BYTES", size)
        monkeypatch.setattr(R, "PATTERN_WINDOWS", cut)
        assert R.locate(b" " + words.tobytes(), offs, first, recurs, window).tolist() == [x for _, g in want for x in g]


def test_shards_keep_every_row_and_their_size(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(R, "SHARD_BYTES", 100)
    monkeypatch.setattr(R, "SHARD_ROWS", 7)
    texts = ["x" * (i * 37 % 90) for i in range(50)] + [None, "y" * 500, ""]
    batch = pa.RecordBatch.from_pydict({"k": list(range(53)), "text": texts})
    packed = list(R._packer("text")(iter([batch.slice(0, 20), batch.slice(20)])))
    shards = [R.Shard(p["payload"][0].as_py(), "text") for p in packed]
    assert [t for s in shards for t in s.rows["text"].to_pylist()] == texts
    assert all(p["bytes"][0].as_py() <= 100 or s.rows.num_rows == 1 for p, s in zip(packed, shards))
    assert all(s.rows.num_rows <= 7 or p["bytes"][0].as_py() for p, s in zip(packed, shards))


def test_code_of_equal_places_only():
    """Two words of 1,024 bytes that a polynomial of any base modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ k] for b in bits).encode() for k in (0, 1))
    data = np.frombuffer(one + b" " + other + b" " + one, np.uint8)
    codes = textcodes.span_codes(data, *textcodes.spans(data, textcodes.NOT_SPACE))
    assert codes[0] == codes[2] != codes[1]
