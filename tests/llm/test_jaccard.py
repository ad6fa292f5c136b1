import random
import re

import numpy as np
import pytest

from staylens.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=5, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40 if seed % 2 else 400)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 9, 10, 14, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t += passage
        if rng.random() < 0.3:
            t = t[rng.randint(0, 2):]
        rows.append((rng.randint(0, 10 ** 6), rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in t)))
    rows = list({k: (k, t) for k, t in rows}.values())
    return rows + [(2_000_000, None), (2_000_001, ""), (2_000_002, " \n"), (2_000_003, "one two"), (2_000_004, "ONE  two"),
                   (2_000_005, "ab"), (2_000_006, " ".join(words[:10])), (2_000_007, " ".join(words[:9])), rows[0], rows[0]]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, monkeypatch):
    if seed % 2:                 # many buckets, flushes and blocks; frequent shingles
        monkeypatch.setattr(J, "BUCKET", 200)
        monkeypatch.setattr(J, "GATHER", 300)
        monkeypatch.setattr(J, "FREQUENT", 4)
        monkeypatch.setattr(J, "BLOCK", 3)
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.digest(frame).collect()))
    assert got == brute(rows)
    if seed == 1:
        kept = J.keep_one(frame).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted({c if s else k for k, s, c in brute(rows)})


@pytest.mark.parametrize("boundary", [0, 8, 10 ** 6])
def test_any_boundary_finds_the_same(spark, boundary, monkeypatch):
    monkeypatch.setattr(J, "choose_boundary", lambda *a: boundary)
    rows = corpus(5, 100)
    rows = [(k, " ".join((t or "").split()[:40])) for k, t in rows]
    got = sorted(map(tuple, J.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_boundary_weighs_cost():
    assert J.choose_boundary([], {}, 80) == 0
    bins = lambda n: int(J.size_bin(n))
    long_lists = [(bins(10), 100 * 3, 100 * 3 * 1000), (bins(1000), 201, 201)]
    assert J.choose_boundary(long_lists, {10: 100, 1000: 1}, 80) == 12
    assert J.choose_boundary([(bins(1000), 201, 201)], {1000: 1}, 80) == 0


def test_other_thresholds(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9)))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((1, 50), (2, 60), (3, 100)):
        got = sorted(tuple(r) for r in J.jaccard_components(frame, n=n, percent=percent).collect())
        assert got == brute(rows, n, percent), (n, percent)


def test_empty_clashing_and_null_keys(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "p"), (2, "a b c d e f", "q"), (None, "a b c d e f", "r"), (None, None, "s")],
                                  "doc_id long, text string, cls string")
    assert J.digest(frame.limit(0)).count() == 0 and J.keep_one(frame.limit(0)).count() == 0
    assert sorted((str(r[0]), r[1], r[2]) for r in J.digest(frame).collect()) == [("1", 2, 1), ("2", 2, 1), ("None", 0, None), ("None", 2, 1)]
    kept = J.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r["cls"] for r in kept.collect()) == ["p", "s"]


def test_components(spark):
    from staylens.llm.components import connected_components
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)]
    rng.shuffle(edges)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlap_bound_is_never_too_low():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[:rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 62, rng.integers(1, 100)).astype(np.uint64)]))
        maps = []
        for s in (a, b):
            bits = np.zeros(J.BITS, np.uint8)
            bits[(s % np.uint64(J.BITS)).astype(np.int64)] = 1
            maps.append(np.packbits(bits).view(np.uint64)[None])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert J._may_link(np.array([len(a)]), np.array([len(b)]), *maps, 80).all()


def near_copies(n, seed=0):
    """A group in which most texts link with some others, and none with the first."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_a_large_group_of_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    made = []
    keep = J.written

    def watched(df, name):
        out = keep(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(J, "written", watched)
    rows = near_copies(300)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.digest(frame).collect())) == brute(rows)
    assert block < 512 or all(n < len(rows) for name, n in made if name == "joining-links"), made


def test_repeated_rows_and_rows_without_a_key_stay_linear(spark, monkeypatch):
    made = {}
    keep = J.written

    def watched(df, name):
        out = keep(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(J, "written", watched)
    one = " ".join(f"a{i}" for i in range(80))
    two = " ".join([f"a{i}" for i in range(78)] + ["z", "y"])
    rows = [(5, one)] * 1000 + [(6, two)] * 1000 + [(None, " ".join([f"a{i}" for i in range(79)] + [f"n{i}"])) for i in range(500)]
    rows += [(None, f"alone {i} words that nobody else has at all {i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.jaccard_components(frame).collect()
    assert sum(r["component"] == 5 for r in got) == 2500 and sum(r["component"] is None for r in got) == 500
    assert made["shingle-sets"] <= 502 and made.get("shingle-links", 0) <= 502, made
    assert J.keep_one(frame).count() == 501


def test_a_key_with_two_texts_belongs_to_two_groups(spark):
    long = [f"w{i}" for i in range(40)]
    rows = [(2, " ".join(long)), (5, " ".join(long + ["end"])), (5, "another text of its own, with other words"), (7, " ".join(long))]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[2]])


def test_sets_beyond_the_exact_sizes_may_be_light(spark, monkeypatch):
    monkeypatch.setattr(J, "EXACT_SIZES", 3)
    rows = corpus(2, 120)
    assert sorted(map(tuple, J.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    rows = [(1, f"a b {one} c d"), (2, f"a b {other} c d"), (3, f"a b {one} c d")]
    assert sorted(map(tuple, J.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
