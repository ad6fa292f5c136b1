import random

import numpy as np
import pytest

from staylens.llm import hnsw as H


def rows(seed, n=250):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    out = []
    for i in range(n):
        v = centres[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0.05, 0.25, 0.5])
        out.append((int(i * 3 + 1), [float(np.float32(x)) for x in v], int(rng.integers(3))))
    out += [(out[0][0] + 10_000 + k, out[0][1], out[0][2]) for k in range(5)] + [out[1], out[1]]
    inf, nan = float("inf"), float("nan")
    out += [(20_000 + k, v, y) for k, (v, y) in enumerate([(None, 1), ([0.0] * 8, 1), ([1.0, None] * 4, 1), ([nan] * 8, 1), ([inf] * 8, 1), ([], 1),
                                                           (out[0][1], None), (out[0][1][:4], out[0][2]), ([1e-30] * 8, 1), ([3e38] * 8, 1)])]
    return out


def brute(data, least=H.COSINE):
    good = [(v is not None and y is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)) for _, v, y in data]
    up = list(range(len(data)))
    count = [0] * len(data)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if good[i] and good[j] and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]):
                a, b = (np.array(data[k][1], float) / np.abs(data[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    count[i] += 1
                    count[j] += 1
                    up[find(i)] = find(j)
    first = {}
    for i, (k, *_) in enumerate(data):
        first[find(i)] = min(first.get(find(i), k), k)
    return sorted((k, count[i], first[find(i)], k == first[find(i)]) for i, (k, *_) in enumerate(data))


@pytest.mark.parametrize("shard", [8192, 40])
def test_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(H, "SHARD", shard)
    data = rows(shard)
    random.Random(1).shuffle(data)
    frame = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, label int, cls string")
    assert sorted(map(tuple, H.digest(frame).collect())) == brute(data)
    assert H.digest(frame.limit(0)).count() == 0


def test_recall_of_the_graph():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32)) * 0.25
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = H.lookups(H.Graph(x), x, 0.93)
    true = x @ x.T >= 0.93
    assert sum(true[i, f].sum() for i, f in enumerate(found)) >= 0.98 * true.sum()
    assert all(true[i, f].all() for i, f in enumerate(found))


class Narrow:
    """A graph whose narrow beams lose the links of vectors with few of them."""

    def __init__(self, x):
        self.x = x

    def within(self, q, least, width):
        hits = np.flatnonzero(self.x @ q >= least)
        return hits if len(hits) > 50 or width >= 256 else hits[self.x[hits] @ q > 1 - 1e-9]


def sparse_links(pairs, cluster, alone):
    """Vectors of which `pairs` pairs and one cluster link, and the links."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(pairs + alone + 1, 64))
    x = np.concatenate([x, x[:pairs] + rng.normal(size=(pairs, 64)) * 0.05, x[-1] + rng.normal(size=(cluster, 64)) * 0.02])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, x @ x.T >= 0.93


@pytest.mark.parametrize("pairs, cluster, alone", [(1, 0, 3000), (300, 0, 1500), (300, 600, 1000)])
def test_audit_notices_lost_links_where_links_are_rare_or_uneven(pairs, cluster, alone):
    x, true = sparse_links(pairs, cluster, alone)
    np.fill_diagonal(true, False)
    assert true.sum() >= 2 * pairs
    found = H.lookups(Narrow(x), x, 0.93, True)
    assert all(np.array_equal(np.flatnonzero(t), np.sort(f)) for t, f in zip(true, found))


def test_audit_between_shards_with_hardly_any_links():
    x, true = sparse_links(2, 0, 3000)
    half = len(x) - 2                            # the second of each pair lies in the other shard
    other = np.concatenate([np.random.default_rng(6).normal(size=(2000, 64)), x[half:]])
    other /= np.linalg.norm(other, axis=1)[:, None]
    found = H.lookups(Narrow(x[:half]), other, 0.93)
    assert sum(map(len, found)) == (x[:half] @ other.T >= 0.93).sum() >= 2


def test_a_shard_of_near_copies_is_counted_in_bounded_memory():
    import resource
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = H.Graph(x)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    links = H.linked(graph, graph, 0.93, True)
    assert links.sum() == 3000 * 2999 and not links.diagonal().any()
    row, _ = H.trees(links, True)
    assert (row == 0).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_trees_of_two_shards_against_a_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        links = rng.random((rng.integers(1, 15), rng.integers(1, 15))) < 0.12
        row, column = H.trees(links, False)
        up = {}

        def find(v):
            while up.setdefault(v, v) != v:
                v = up[v]
            return v

        for i, j in zip(*np.nonzero(links)):
            up[find(("b", j))] = find(("a", i))
        for i in range(len(row)):
            assert (row[i] >= 0) == links[i].any()
            assert all((row[i] == row[k]) == (find(("a", i)) == find(("a", k))) for k in range(len(row)) if links[i].any() and links[k].any())
        for j in range(len(column)):
            assert (column[j] >= 0) == links[:, j].any()
            if column[j] >= 0:
                assert find(("b", j)) == find(("a", int(column[j])))
