"""Near-duplicate vectors: a navigable small-world graph per shard.

Copies of a vector form a class. The classes of a label are dealt into shards
of bounded size, and each shard gets a graph. Every vector is then looked up
in every shard of its label: for two shards at a time, both ways, so a link
found from either side counts for both. A sample of the lookups that have
links is audited against all vectors of the shard, and the beam is widened
until the audit passes. Links are decided by the cosine in double precision. What leaves a
task is a count and one tree edge per vector, not the pairs.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.components import connected_components
from staylens.llm.shared import col, open_fs, shared_path, small_batches, tidy, written

COSINE = 0.93
#: Vectors in one graph, at most about; links kept per vector on the ground
#: layer and above; beam while building, and at first while searching.
SHARD = 8192
GROUND, UPPER, BUILD_BEAM, BEAM = 32, 16, 64, 48
#: Lookups with links audited for each side of a pair of shards, and the share of
#: a lookup's links that they must find on average before the beam stops growing.
AUDITED, RECALL = 200, 0.995
#: Rows of a table of links handled at once; tasks that compare pairs of shards, at most.
ROWS, MAX_TASKS = 512, 20_000


class Graph:
    """Hierarchical navigable small world over unit vectors (rows of `x`)."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(UPPER)).astype(int), 12)
        self.ground = np.full((n, 2 * GROUND), -1, np.int32)     # links grow to twice the number, then are thinned
        self.degree = np.zeros(n, np.int32)
        self.above: list[dict[int, list[int]]] = [{} for _ in range(13)]
        self.entry, self.top = 0, int(self.level[0]) if n else 0
        self.seen = np.zeros(n, np.int64)
        self.turn = 0
        for i in range(n):
            self._insert(i)

    def _near(self, ids: np.ndarray, layer: int) -> np.ndarray:
        if layer == 0:
            out = self.ground[ids].ravel()
            return out[out >= 0]
        return np.array([j for i in ids.tolist() for j in self.above[layer].get(i, ())], np.int64)

    def _descend(self, q: np.ndarray, to: int) -> int:
        """The best vector found greedily on the layers above `to`."""
        at = self.entry
        best = self.x[at] @ q
        for layer in range(self.top, to, -1):
            while True:
                near = self.above[layer].get(at)
                if not near:
                    break
                sims = self.x[near] @ q
                k = int(sims.argmax())
                if sims[k] <= best:
                    break
                at, best = near[k], sims[k]
        return at

    def beam(self, q: np.ndarray, start: list[int], width: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best vectors found from `start`, best first; the open ones
        among them are expanded together, until none is open."""
        self.turn += 1
        ids = np.array(start, np.int64)
        self.seen[ids] = self.turn
        sims = self.x[ids] @ q
        is_open = np.ones(len(ids), bool)
        while is_open.any():
            near = self._near(ids[is_open], layer)
            is_open[:] = False
            near = np.unique(near[self.seen[near] != self.turn])
            if not len(near):
                break
            self.seen[near] = self.turn
            ids, sims = np.concatenate([ids, near]), np.concatenate([sims, self.x[near] @ q])
            is_open = np.concatenate([is_open, np.ones(len(near), bool)])
            if len(ids) > width:
                keep = np.argpartition(-sims, width - 1)[:width]
                ids, sims, is_open = ids[keep], sims[keep], is_open[keep]
        order = np.argsort(-sims, kind="stable")
        return ids[order], sims[order]

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Close ones that are not closer to one already chosen; filled up with the closest."""
        if len(ids) <= most:
            return ids
        between = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        nearest = np.full(len(ids), -2.0)
        for k in range(len(ids)):
            if nearest[k] < sims[k]:
                chosen.append(k)
                np.maximum(nearest, between[k], out=nearest)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [k for k in range(len(ids)) if k not in taken][:most - len(chosen)]
        return ids[chosen]

    def _link(self, i: int, others: np.ndarray, layer: int) -> None:
        if layer:
            links = self.above[layer]
            links[i] = others.tolist()
            for j in links[i]:
                links.setdefault(j, []).append(i)
                if len(links[j]) > 2 * UPPER:
                    near = np.array(links[j])
                    sims = self.x[near] @ self.x[j]
                    order = np.argsort(-sims, kind="stable")
                    links[j] = self._choose(near[order], sims[order], UPPER).tolist()
            return
        self.ground[i, :len(others)] = others
        self.degree[i] = len(others)
        full = others[self.degree[others] == 2 * GROUND]
        for j in full.tolist():
            near = self.ground[j].astype(np.int64)
            sims = self.x[near] @ self.x[j]
            order = np.argsort(-sims, kind="stable")
            chosen = self._choose(near[order], sims[order], GROUND)
            self.ground[j] = -1
            self.ground[j, :len(chosen)] = chosen
            self.degree[j] = len(chosen)
        self.ground[others, self.degree[others]] = i
        self.degree[others] += 1

    def _insert(self, i: int) -> None:
        level = int(self.level[i])
        if i:
            q = self.x[i]
            at = [self._descend(q, level)] if level < self.top else [self.entry]
            for layer in range(min(level, self.top), -1, -1):
                ids, sims = self.beam(q, at, BUILD_BEAM, layer)
                self._link(i, self._choose(ids, sims, GROUND if layer == 0 else UPPER), layer)
                at = ids.tolist()
        for layer in range(1, level + 1):
            self.above[layer].setdefault(i, [])
        if level > self.top or not i:
            self.entry, self.top = i, level

    def within(self, q: np.ndarray, least: float, width: int) -> np.ndarray:
        """Vectors found with a product of at least `least`: a beam, then every
        vector that is linked to a found one, as long as there are new ones."""
        ids, sims = self.beam(q, [self._descend(q, 0)], min(width, len(self.x)))
        new = ids[sims >= least]
        self.turn += 1                 # what the beam dropped may come back over links
        self.seen[new] = self.turn
        found = [new]
        while len(new):
            near = self._near(new, 0)
            near = np.unique(near[self.seen[near] != self.turn])
            self.seen[near] = self.turn
            new = near[self.x[near] @ q >= least]
            found.append(new)
        return np.unique(np.concatenate(found))


def _links(graph: Graph, queries: np.ndarray, places: np.ndarray, least: float, own: bool) -> list[np.ndarray]:
    """All links of some queries, by brute force; a query of the graph's own does not link with itself."""
    hits = queries[places] @ graph.x.T >= least
    if own:
        hits[np.arange(len(places)), places] = False
    return [np.flatnonzero(h) for h in hits]


def lookups(graph: Graph, queries: np.ndarray, least: float, own: bool = False) -> list[np.ndarray]:
    """Found links of every query, as a list; see `each_lookup`."""
    found = dict(each_lookup(graph, queries, least, own))
    return [found[k] for k in range(len(queries))]


def each_lookup(graph: Graph, queries: np.ndarray, least: float, own: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(query, its links found), with a beam as wide as the audit asks for.

    Queries are drawn until AUDITED of them have links; each counts the same,
    however many links it has. If there are not that many, all links are known
    by then and given. `own`: the queries are the graph's vectors, and no
    vector links with itself. Only the audited lookups are held at once.
    """
    n = len(queries)
    drawn = np.random.default_rng(7).permutation(n)
    true: dict[int, np.ndarray] = {}
    linked: list[int] = []
    for at in range(0, n, AUDITED):
        places = drawn[at:at + AUDITED]
        true.update(zip(places.tolist(), _links(graph, queries, places, least, own)))
        linked = [k for k, t in true.items() if len(t)]
        if len(linked) >= AUDITED:
            break
    if len(true) < n:
        linked = linked[:AUDITED]
        width = BEAM
        while width < len(graph.x):
            if np.mean([np.isin(true[k], graph.within(queries[k], least, width)).mean() for k in linked]) >= RECALL:
                for k in range(n):
                    hits = true[k] if k in true else graph.within(queries[k], least, width)
                    yield k, hits[hits != k] if own else hits
                return
            width *= 2
        rest = np.array([k for k in range(n) if k not in true])          # the widest beam is the whole shard
        for at in range(0, len(rest), AUDITED):
            places = rest[at:at + AUDITED]
            yield from zip(places.tolist(), _links(graph, queries, places, least, own))
    yield from true.items()


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(v, np.float64).tobytes() for v in batch["vector"].to_pylist()]
        labels = batch["label"].to_pylist()
        cls = [int.from_bytes(hashlib.blake2b(y.encode() + b"\0" + v, digest_size=8).digest(), "little", signed=True) for v, y in zip(vectors, labels)]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(cls, pa.int64()), pa.array(vectors, pa.binary())],
                                         names=["id", "label", "cls", "vector"])


def _builder(folder: str):
    def build(table: pa.Table) -> pa.Table:
        """A shard's graph in a file of its own; a retried task writes another one."""
        order = np.argsort(table["cls"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        x = np.stack([_unit(v) for v in table["vector"].to_pylist()])
        path = f"{folder}/{uuid.uuid4().hex}.graph"
        fs, inner = open_fs(path)
        if isinstance(fs, pa.fs.LocalFileSystem):
            fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner, compression=None) as sink:
            sink.write(pickle.dumps((table["cls"].to_numpy(), table["times"].to_numpy(), Graph(x)), protocol=5))
        return pa.table({"label": table["label"].slice(0, 1), "dim": pa.array([x.shape[1]], pa.int32()), "shard": table["shard"].slice(0, 1),
                         "path": pa.array([path])})
    return build


def _load(path: str) -> tuple[np.ndarray, np.ndarray, Graph]:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner, compression=None) as source:
        return pickle.loads(source.read())


def linked(a: Graph, b: Graph, least: float, same: bool) -> np.ndarray:
    """A table of bytes: which vectors of `a` link with which of `b`, found from
    either side and decided by the cosine in double precision."""
    links = np.zeros((len(a.x), len(b.x)), bool)
    for k, hits in each_lookup(a, b.x, least, same):
        links[hits, k] = True
    if same:
        links |= links.T.copy()
    else:
        for k, hits in each_lookup(b, a.x, least):
            links[k, hits] = True
    for i in np.flatnonzero(links.any(1)).tolist():
        at = np.flatnonzero(links[i])
        links[i, at[np.einsum("ij,j->i", b.x[at], a.x[i]) < least]] = False
    return links


def _reached(links: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Columns that some of these rows link with."""
    out = np.zeros(links.shape[1], bool)
    for at in range(0, len(rows), ROWS):
        out |= links[rows[at:at + ROWS]].any(0)
    return out


def trees(links: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Root (a row) of every row and of every column over the links, -1 for those without."""
    back = links if same else np.ascontiguousarray(links.T)
    row = np.full(links.shape[0], -1)
    column = row if same else np.full(links.shape[1], -1)
    for i in np.flatnonzero(links.any(1)).tolist():
        if row[i] >= 0:
            continue
        front = np.array([i])
        row[i] = i
        while len(front):
            front = np.flatnonzero(_reached(links, front) & (column < 0))
            column[front] = i
            if not same:
                front = np.flatnonzero(_reached(back, front) & (row < 0))
                row[front] = i
    return row, column


def _search(least: float):
    """For each pair of shards, a count and one tree edge for every class with links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch["path"].to_pylist(), batch["other"].to_pylist()):
                same = one == other
                cls_a, times_a, a = _load(one)
                cls_b, times_b, b = (cls_a, times_a, a) if same else _load(other)
                links = linked(a, b, least, same)
                root_a, root_b = trees(links, same)
                count_a, count_b = np.zeros(len(cls_a), np.int64), np.zeros(len(cls_b), np.int64)
                for at in range(0, len(cls_a), ROWS):
                    part = links[at:at + ROWS]
                    count_a[at:at + ROWS] = part @ times_b.astype(np.float64)
                    count_b += (times_a[at:at + ROWS].astype(np.float64) @ part).astype(np.int64)
                parts = [(cls_a, count_a, root_a)] + ([] if same else [(cls_b, count_b, root_b)])
                some = [r >= 0 for _, _, r in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in (
                        [c[k] for (c, _, _), k in zip(parts, some)], [n[k] for (_, n, _), k in zip(parts, some)],
                        [cls_a[r[k]] for (_, _, r), k in zip(parts, some)])], names=["cls", "count", "root"])
    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Per row: id, n_links (other rows linked directly: equal labels and a
    cosine of at least `cosine`), component (least id reachable over links).

    Rows with a null label, or a vector that is null, empty, zero or holds null
    or non-finite components, link with nothing. Vectors of different length
    do not link. Repeated rows link with each other; a null id is never the
    least unless all are null. Other columns are ignored; no rows, no result.
    Equal vectors of a label are told from others by 64-bit codes.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(col(key).alias("id"), col(label).cast("string").alias("label"), col(vector).alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    kind = rows.schema["id"].dataType.simpleString()
    known = written(rows.where(sound).mapInArrow(_classes, f"id {kind}, label string, cls bigint, vector binary"), "vectors")
    classes = written(known.groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"),
                                               F.first("vector").alias("vector")), "vector-classes")
    dim = F.octet_length("vector")
    sizes = classes.groupBy("label", dim.alias("dim")).agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    dealt = classes.withColumn("dim", dim).join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("cls"), "shards").cast("int"))
    graphs = written(dealt.select("label", "dim", "shard", "cls", "times", "vector").groupBy("label", "dim", "shard")
                     .applyInArrow(_builder(shared_path(spark, "graph-files")), "label string, dim int, shard int, path string"), "graphs")
    # pairs are of paths; their number, not their size, makes the work, so they are dealt evenly
    a = graphs.select("label", "dim", F.col("shard").alias("i"), "path")
    b = graphs.select("label", "dim", F.col("shard").alias("j"), F.col("path").alias("other"))
    pairs = written(a.join(b, ["label", "dim"]).where("i <= j").select("path", "other"), "graph-pairs")
    dealt = pairs.repartition(max(1, min(pairs.count(), MAX_TASKS)))
    found = written(dealt.mapInArrow(tidy(_search(cosine)), "cls bigint, count bigint, root bigint"), "vector-links")
    counts = found.groupBy("cls").agg(F.sum("count").alias("count"))
    components = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    told = classes.join(counts, "cls", "left").join(components, "cls", "left").select("cls", "id", "times", "count", F.coalesce("component", "cls").alias("component"))
    least = told.groupBy("component").agg(F.min("id").alias("least"))
    of_class = written(told.join(least, "component").select("cls", (F.coalesce("count", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least"), "vector-components")
    linked = known.select("id", "cls").join(of_class, "cls").select("id", "n_links", F.col("least").alias("component"))
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)


def digest(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                                              F.col("id").eqNullSafe(F.col("component")).alias("kept"))
