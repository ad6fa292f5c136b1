"""Similarity self-join of texts on their sets of word n-grams, size-aware.

Two texts link when 100 * |A and B| >= percent * |A or B|. Steps:

1. Texts with equal sets form a class; only classes are compared.
2. Filter: a partner shares at least `percent` of a set, so at least k
   shingles of both sets' prefixes (in hash order) agree. Prefixes of all
   classes meet in buckets of bounded size; classes with too few shared
   prefix shingles have no partner and are done.
3. Keys of the rest, shingles ordered with very frequent ones last. Light
   (small) sets enumerate the 2-subsets of their prefix; heavy (large) ones
   are found through inverted lists of single prefix shingles. The boundary
   between the two is chosen by their summed cost.
4. In every key list, each class is checked against the list's first; links
   are joined to components.
5. In lists that still hold several components, members are looked for that
   may link with one of another component, by size and an upper bound of the
   overlap from bitmaps. Lists are looked through in blocks of bounded size;
   members outside a list's largest component visit every block of sizes near
   theirs. Not pairs leave a task, but links that hold what may link together,
   one for a member at most; their components are clusters.
6. Each class goes once, with its full set, to a block of its cluster, which
   names the links that join components, fewer than it has members. Of clusters
   that hold several components even then, members that may still link (by
   bitmaps, as before) are compared in blocks with visitors.

Two classes that link share a key, so they are in one component before the
last step or in one cluster and compared in it: no link between components is
lost, and only links that join components ever leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import textcodes
from staylens.llm.components import connected_components
from staylens.llm.shared import col, discard, free_name, small_batches, tidy, written

N, PERCENT = 5, 80
#: Prefix shingles meeting in one bucket of the filter, about.
BUCKET = 1 << 20
#: Prefix shingles that small sets must share: fewer in common, as a phrase that
#: many texts hold, make no partner.
SURE = 4
#: Shingles gathered in a task before they are sent to the buckets.
GATHER = 1 << 20
#: Shingles in at least this many classes go last in the order of prefixes;
#: of these at most so many, the most frequent. Only the order depends on it.
FREQUENT, MAX_FREQUENT = 100, 1 << 16
#: Bits of a set's bitmap; members of a list in one block, about.
BITS, BLOCK = 1024, 512
#: Sets compared with one at once; what they join is looked at in between.
AT_ONCE = 64
#: Sizes beyond are counted by bins when the boundary is chosen.
EXACT_SIZES = 1 << 12
#: Cost of comparing two members of a list (bitmaps, in one task) in units of
#: the cost of a key (written, shuffled, grouped).
COMPARE = 1 / 64
#: Classes whose shared shingles are summed in one task, about.
CREDITED = 1 << 19
BLOCK_BYTES = 4 << 20


def _needed(n, percent: int):
    """Shingles that a set of n has in common with any partner, at least."""
    return -(-n * percent // 100)


def filter_length(n, percent: int):
    """Prefix of a set of n in the filter: what a partner may lack, and n / 8 or
    SURE more. Prefixes of two that link agree in so many of the smaller set, and
    that has at least `_needed` shingles."""
    return np.minimum(n, n - _needed(n, percent) + np.maximum(np.minimum(n, SURE), n // 8))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle codes of each text."""
    data, offsets = textcodes.buffers(texts)
    words, first = textcodes.word_codes(data, offsets, textcodes.NOT_SPACE)

    def join(parts: list[np.ndarray]) -> np.ndarray:
        code = np.full(len(parts[0]), np.uint64(len(parts)))
        for p in parts:
            code = textcodes.mix(code * np.uint64(0x9E3779B97F4A7C15) + p)
        return code

    full = join([words[k:len(words) - n + 1 + k] for k in range(n)]) if len(words) >= n else words[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(full[a:b - n + 1])
        elif b > a:
            yield join([words[k:k + 1] for k in range(a, b)])
        else:
            yield words[:0]


def set_code(shingles: np.ndarray) -> int:
    """A class id, below zero as a signed number: all sets with equal codes are one class."""
    import hashlib
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) | -1 << 63


def _sets(batches, text: str, n: int):
    for batch in batches:
        for i, j in textcodes.blocks(batch[text], BLOCK_BYTES):
            yield batch.slice(i, j - i), list(shingle_sets(batch[text].slice(i, j - i), n))


def _classes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, "text", n):
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["mark"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_code(s) if len(s) else None for s in sets], pa.int64())],
                names=["id", "mark", "size", "cls"])
    return run


def _to_buckets(text: str, n: int, percent: int, n_buckets: int, gather: int):
    """Prefix shingles of the classes, gathered per task. A shingle that is alone
    goes with its class; one that several classes here share goes once, with
    their number, and these classes are credited at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[int] = []
        seen: set[int] = set()
        size = 0

        def flush():
            tokens = np.concatenate(held)
            cls = np.repeat(np.array(owners, np.int64), [len(x) for x in held])
            order = np.argsort(tokens, kind="stable")
            tokens, cls = tokens[order], cls[order]
            start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            count = np.diff(np.append(start, len(tokens)))
            credited, times = np.unique(cls[np.repeat(count > 1, count)], return_counts=True)
            slot = np.where(count > 1, count, cls[start])
            tokens = tokens[start]
            for kind, a, b, bucket in ((0, tokens, slot, tokens % np.uint64(n_buckets)), (1, credited, times, credited.view(np.uint64) % np.uint64(n_buckets))):
                by = np.argsort(bucket, kind="stable")
                a, b, ends = a[by], b[by], np.searchsorted(bucket[by], np.arange(n_buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()),
                     pa.array([a[ends[k]:ends[k + 1]].tobytes() for k in some], pa.binary()),
                     pa.array([b[ends[k]:ends[k + 1]].astype(np.int64).tobytes() for k in some], pa.binary())],
                    names=["bucket", "kind", "a", "b"])

        for _, sets in _sets(batches, text, n):
            for s in sets:
                if not len(s):
                    continue
                c = set_code(s)
                if c in seen:
                    continue
                seen.add(c)
                held.append(s[:int(filter_length(len(s), percent))])
                owners.append(c)
                size += len(held[-1])
                if size >= gather:
                    yield from flush()
                    held, owners, seen, size = [], [], set(), 0
        if held:
            yield from flush()
    return run


def _meet(table: pa.Table, frequent_from: int, parts: int) -> pa.Table:
    """One bucket: the classes with shared shingles and how many, packed by the
    part that sums them up, and (part -1) the frequent shingles and their classes."""
    def joined(kind: int, name: str, of) -> np.ndarray:
        rows = table.filter(pc.equal(table["kind"], kind))[name]
        return np.concatenate([np.frombuffer(x.as_py(), of) for x in rows] or [np.empty(0, of)])

    tokens, slot = joined(0, "a", np.uint64), joined(0, "b", np.int64)
    order = np.argsort(tokens, kind="stable")
    tokens, slot = tokens[order], slot[order]
    ids, numbers = [joined(1, "a", np.int64)], [joined(1, "b", np.int64)]
    frequent, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(tokens):
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        alone = slot < 0
        classes = np.add.reduceat(np.where(alone, 1, slot), start)
        shared = (np.minimum.reduceat(slot, start) != np.maximum.reduceat(slot, start)) | ~alone[start]
        credited, number = np.unique(slot[np.repeat(shared, np.diff(np.append(start, len(tokens)))) & alone], return_counts=True)
        ids.append(credited)
        numbers.append(number)
        often = classes >= frequent_from
        frequent, times = tokens[start][often], classes[often]
    cls, place = np.unique(np.concatenate(ids), return_inverse=True)
    number = np.bincount(place, np.concatenate(numbers), minlength=len(cls)).astype(np.int64)
    part = (cls.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cls, number, ends = cls[by], number[by], np.searchsorted(part[by], np.arange(parts + 1))
    rows = [(k, cls[ends[k]:ends[k + 1]].tobytes(), number[ends[k]:ends[k + 1]].tobytes()) for k in range(parts) if ends[k] < ends[k + 1]]
    if len(frequent):
        rows.append((-1, frequent.tobytes(), times.astype(np.int64).tobytes()))
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "a": pa.array([r[1] for r in rows], pa.binary()),
                     "b": pa.array([r[2] for r in rows], pa.binary())})


def _meeting(frequent_from: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        return _meet(table, frequent_from, parts)
    return run


def _sum_up(table: pa.Table) -> pa.Table:
    """(id, number) of one part, numbers of equal ids added."""
    ids, numbers = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table[c]]) for c in ("a", "b"))
    ids, place = np.unique(ids, return_inverse=True)
    return pa.table({"id": pa.array(ids), "number": pa.array(np.bincount(place, numbers, minlength=len(ids)).astype(np.int64))})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (a, b)], names=["id", "number"])


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BITS bits for each set, as 64-bit numbers."""
    bits = np.zeros((len(sets), BITS), np.uint8)
    if sets:
        bits[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _full_sets(text: str, n: int):
    """Sets of the rows that stand for their class; a task gives a class once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch, sets in _sets(batches, text, n):
            keep = []
            for k, (s, c) in enumerate(zip(sets, batch["cls"].to_pylist())):
                if len(s) and c not in given and set_code(s) == c:
                    given.add(c)
                    keep.append(k)
            maps = _bitmaps([sets[k] for k in keep])
            yield pa.RecordBatch.from_arrays(
                [batch["cls"].take(pa.array(keep, pa.int64())), pa.array([len(sets[k]) for k in keep], pa.int64()),
                 pa.array([sets[k].tobytes() for k in keep], pa.binary()), pa.array([m.tobytes() for m in maps], pa.binary())], names=["cls", "size", "shingles", "bitmap"])
    return run


def _ordered(shingles: bytes, frequent: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A set's shingles in the common order: by code, frequent ones last by frequency."""
    s = np.frombuffer(shingles, np.uint64)
    if not len(frequent):
        return s
    k = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    times = np.where(frequent[k] == s, number[k], 0)
    return s[np.argsort(times, kind="stable")]


def size_bin(size):
    """Logarithmic bins of set sizes (about 12 to a doubling)."""
    return np.floor(12 * np.log2(np.maximum(1, size))).astype(np.int64)


def _postings(frequent, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, number = frequent.value
        for batch in batches:
            out, bins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for size, s in zip(batch["size"].to_pylist(), batch["shingles"].to_pylist()):
                out.append(_ordered(s, codes, number)[:size - int(_needed(size, percent)) + 1])
                bins.append(np.full(len(out[-1]), size_bin(size)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(bins))], names=["token", "bin"])
    return run


def choose_boundary(rows: list[tuple[int, int, int]], sets: dict[int, int], percent: int) -> int:
    """Largest size of a light set, with the least summed cost.

    `rows`: (size bin, postings, sum of the lengths of the lists they are in);
    `sets`: size -> number of sets. A light set costs its 2-subsets; a set that
    heavy ones may link with costs its postings, and for half the lists they
    meet a comparison, which is `COMPARE` of the cost of a key."""
    per_set = {}
    total = {}
    for size, n in sets.items():
        b = int(size_bin(size))
        total[b] = total.get(b, 0) + n
    for b, postings, scanned in rows:
        per_set[b] = (postings + COMPARE * scanned / 2) / max(1, total.get(b, 1))
    sizes = sorted(sets)
    light = np.cumsum([sets[s] * (m + 2) * (m + 1) / 2 for s in sizes for m in [s - int(_needed(s, percent))]])
    heavy = np.cumsum([sets[s] * per_set.get(int(size_bin(s)), 1.0) for s in sizes])
    best, cost = 0, heavy[-1] if len(sizes) else 0
    for x in sorted({*sizes, *(s * 100 // percent for s in sizes)}):
        listed = np.searchsorted(sizes, int(_needed(x + 1, percent)))       # these may link with heavy sets
        c = light[np.searchsorted(sizes, x, "right") - 1] + heavy[-1] - (heavy[listed - 1] if listed else 0)
        if c < cost:
            best, cost = x, c
    return best


def _keys(frequent, percent: int, boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, number = frequent.value
        listed = int(_needed(boundary + 1, percent))
        for batch in batches:
            keys, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for cls, size, s in zip(batch["cls"].to_pylist(), batch["size"].to_pylist(), batch["shingles"].to_pylist()):
                order = _ordered(s, codes, number)
                spare = size - int(_needed(size, percent))
                new = []
                if size <= boundary:         # light partners share two of the first spare + 2
                    head = order[:spare + 2]
                    if len(head) > 1:
                        a, b = np.triu_indices(len(head), 1)
                        low, high = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
                        new.append(textcodes.mix(textcodes.mix(low + np.uint64(1)) + high))
                if size >= listed or size - spare < 2:
                    new.append(order[:spare + 1])
                keys += new
                owner.append(np.full(sum(map(len, new)), cls, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))], names=["key", "cls"])
    return run


def _may_link(size_a, size_b, maps_a, maps_b, percent: int):
    """Can the overlap, bounded from the bitmaps, be enough?"""
    apart = np.bitwise_count(maps_a ^ maps_b).sum(-1, dtype=np.int64)
    total = size_a + size_b
    most = np.minimum((total - apart) // 2, np.minimum(size_a, size_b))
    return (100 + percent) * most >= percent * total


def _maps(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64) if raw else np.empty((0, BITS // 64), np.uint64)


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch[c].to_numpy() for c in ("size_a", "size_b"))
            ok = _may_link(a, b, _maps(batch["map_a"]), _maps(batch["map_b"]), percent)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok))
    return run


class _Block:
    """Members of one block, and the links found that join their components."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rows: list[tuple] = []      # cls, size, component, is a visitor elsewhere, set
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []
        self.closed = False

    def _root(self, c: int) -> int:
        while (above := self.up.get(c, c)) != c:
            self.up[c] = self.up.get(above, above)
            c = above
        return c

    def _join(self, a: int, b: int) -> None:
        """One component from here on."""
        self.up[b] = a
        self.label[self.label == b] = a

    def _overlap(self, s: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Elements that the set has in common with each member."""
        theirs = [self.sets[k] for k in members.tolist()]
        flat = np.concatenate(theirs)
        hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
        return np.add.reduceat(hit, np.cumsum([0] + [len(x) for x in theirs[:-1]]))

    def _look(self, cls: int, size: int, component: int, s: np.ndarray, bits: np.ndarray, members: np.ndarray) -> None:
        """Compare a set with members, those of its component left out as it grows."""
        mine = self._root(component)
        members = members[self.label[members] != mine]
        if len(members):
            members = members[_may_link(size, self.size[members], bits, self.maps[members], self.percent)]
        while len(members):
            now, members = members[:AT_ONCE], members[AT_ONCE:]
            common = self._overlap(s, now)
            good = now[100 * common >= self.percent * (size + self.size[now] - common)]
            for k in good.tolist():
                if self.label[k] != mine:
                    self.links.append((cls, int(self.cls[k])))
                    self._join(mine, int(self.label[k]))
            if len(good):
                members = members[self.label[members] != mine]

    def close(self) -> None:
        """All members are here: compare them with each other, by size."""
        if self.closed:
            return
        self.closed = True
        self.rows.sort(key=lambda r: (r[1], r[0]))
        columns = list(zip(*self.rows)) or [()] * 5
        self.rows = []
        self.cls, self.size = np.array(columns[0], np.int64), np.array(columns[1], np.int64)
        self.label = np.array([self._root(c) for c in columns[2]], np.int64)
        self.visits, self.sets = np.array(columns[3], bool), list(columns[4])
        self.maps = _bitmaps(self.sets)
        most = np.searchsorted(self.size, self.size * 100 // self.percent, "right")
        for k in range(len(self.cls)):
            if most[k] > k + 1:
                self._look(int(self.cls[k]), int(self.size[k]), int(self.label[k]), self.sets[k], self.maps[k], np.arange(k + 1, most[k]))

    def visit(self, cls: int, size: int, component: int, s: np.ndarray, first: bool) -> None:
        """A member of another block; two visitors meet in the block of the later."""
        lo, hi = np.searchsorted(self.size, [_needed(size, self.percent), size * 100 // self.percent + 1])
        members = np.arange(lo, hi)
        if not first:
            members = members[~self.visits[members]]
        if len(members):
            self._look(cls, size, component, s, _bitmaps([s])[0], members)


def _compare(percent: int):
    """Links that join components, block by block. Rows come sorted by key, peer
    (the block) and visitor (members first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            done = []
            for key, peer, visitor, home, cls, size, component, visits, raw in zip(*(batch[c].to_pylist() for c in _BLOCK_ROWS)):
                if at != (key, peer):
                    if block is not None:
                        block.close()
                        done += block.links
                    block, at = _Block(percent), (key, peer)
                s = np.frombuffer(raw, np.uint64)
                if visitor:
                    block.close()
                    block.visit(cls, size, component, s, home < peer)
                else:
                    block.rows.append((cls, size, component, visits, s))
            if done:
                yield _pairs(done)
        if block is not None:
            block.close()
            yield _pairs(block.links)
    return run


_BLOCK_ROWS = ("key", "peer", "visitor", "home", "cls", "size", "component", "visits", "shingles")
_MARK_ROWS = (*_BLOCK_ROWS[:-1], "bitmap")


def _near(one: dict, two: dict, percent: int) -> np.ndarray:
    """A table of which members of `one` may link with which of `two`, in another component."""
    a, b = one["size"][:, None], two["size"][None]
    bits_a, bits_b = (np.unpackbits(x["maps"].view(np.uint8), axis=1).astype(np.float32) for x in (one, two))
    common = (bits_a @ bits_b.T).astype(np.int64)
    apart = bits_a.sum(1).astype(np.int64)[:, None] + bits_b.sum(1).astype(np.int64)[None] - 2 * common
    most = np.minimum((a + b - apart) // 2, np.minimum(a, b))
    return ((100 + percent) * most >= percent * (a + b)) & (one["component"][:, None] != two["component"][None])


class _Bitmaps:
    """Members of one block by their bitmaps, the visitors they get, and what
    is found of them: with `forest`, links that hold together what may link;
    else (key, cls) of all that may."""

    def __init__(self, percent: int, forest: bool, key: int, columns: dict):
        self.percent, self.forest, self.key = percent, forest, key
        self.rows = {c: v[:0] for c, v in columns.items()}
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, columns: dict, lo: int, hi: int) -> None:
        self.rows = {c: np.concatenate([v, columns[c][lo:hi]]) for c, v in self.rows.items()}

    def close(self) -> None:
        """All members are here."""
        if "label" in self.rows:
            return
        near = _near(self.rows, self.rows, self.percent)
        label = np.arange(len(near))
        while True:                             # least number reached, by doubling
            least = np.where(near, label[None], len(near)).min(1, initial=len(near))
            new = np.minimum(label, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        self.rows["label"] = label
        self._tell(np.flatnonzero(near.any(1)), None)

    def _tell(self, members: np.ndarray, visitors: np.ndarray | None) -> None:
        cls = self.rows["cls"]
        if not self.forest:
            self.found.append((np.full(len(members), self.key), cls[members]))
            if visitors is not None:
                self.found.append((np.full(len(visitors), self.key), visitors))
        elif visitors is None:
            self.found.append((cls[members], cls[self.rows["label"][members]]))

    def visited(self, columns: dict, lo: int, hi: int, peer: int) -> None:
        self.close()
        late = columns["home"][lo:hi] > peer          # two visitors meet in the block of the later
        near = _near({c: v[lo:hi] for c, v in columns.items()}, self.rows, self.percent) & ~(late[:, None] & self.rows["visits"][None])
        cls, some = columns["cls"][lo:hi], near.any(1)
        if not self.forest:
            self._tell(np.flatnonzero(near.any(0)), cls[some])
            return
        label = self.rows["label"]
        for k in np.flatnonzero(some).tolist():
            roots = np.unique(label[near[k]])
            self.found.append((np.full(len(roots), cls[k]), self.rows["cls"][roots]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]


def _mark(percent: int, forest: bool):
    """What may link, from rows sorted by key, peer (the block) and visitor
    (members first): columns a and b, see _Bitmaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            columns = {c: batch[c].to_numpy(zero_copy_only=False) for c in _MARK_ROWS[:-1]} | {"maps": _maps(batch["bitmap"])}
            key, peer, visitor = columns["key"], columns["peer"], columns["visitor"]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (peer[1:] != peer[:-1])])) if len(key) else np.empty(0, np.int64)
            out = []
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(key)]):
                if at != (key[lo], peer[lo]):
                    if block is not None:
                        block.close()
                        out += block.found
                    block, at = _Bitmaps(percent, forest, key[lo], columns), (key[lo], peer[lo])
                mid = lo + int(np.searchsorted(visitor[lo:hi], True))
                if mid > lo:
                    block.add(columns, lo, mid)
                if hi > mid:
                    block.visited(columns, mid, hi, peer[lo])
            if out:
                yield _columns(out)
        if block is not None:
            block.close()
            yield _columns(block.found)
    return run


def _columns(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)], names=["a", "b"])


def _may_meet(rows: DataFrame, about: DataFrame, percent: int, forest: bool) -> DataFrame:
    """What `_mark` finds in lists (key, cls, size, component)."""
    blocks = _visiting(rows, about.select("cls", "bitmap"), percent).select(*_MARK_ROWS)
    blocks = blocks.repartition("key", "peer").sortWithinPartitions("key", "peer", "visitor")
    return written(blocks.mapInArrow(tidy(_mark(percent, forest)), "a bigint, b bigint").distinct(), "may-link")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """The links that join components, from rows of _BLOCK_ROWS."""
    rows = rows.select(*_BLOCK_ROWS).repartition("key", "peer").sortWithinPartitions("key", "peer", "visitor")
    return written(rows.mapInArrow(tidy(_compare(percent)), "a bigint, b bigint"), "joining-links")


def _overlaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                k = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[k] == a).sum())
                good.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets link."""
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
    return written(pairs.join(a, "a").join(b, "b").mapInArrow(_overlaps(percent), "a bigint, b bigint"), "shingle-links")


def _link_classes(sets: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that link with others."""
    about = sets.select("cls", "size", "bitmap")
    lists = keys.groupBy("key").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where("first <> last").select("key", "first")
    stars = keys.join(lists, "key").where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    first = about.select(F.col("cls").alias("a"), F.col("size").alias("size_a"), F.col("bitmap").alias("map_a"))
    other = about.select(F.col("cls").alias("b"), F.col("size").alias("size_b"), F.col("bitmap").alias("map_b"))
    stars = stars.join(first, "a").join(other, "b").mapInArrow(_bounded(percent), "a bigint, b bigint")
    links = _links(stars, sets, percent)
    found = written(connected_components(links), "class-groups")
    discard(links)
    full = sets.select("cls", "shingles")
    rows = _mixed(keys.join(about.select("cls", "size"), "cls"), found)
    held = _may_meet(rows, about, percent, forest=True)
    clusters = written(connected_components(held).join(about.select(F.col("cls").alias("node"), "size"), "node")
                       .select(F.col("component").alias("key"), F.col("node").alias("cls"), "size"), "clusters")
    discard(rows, held)
    rows = _mixed(clusters, found)
    found = _joined(found, _compared(_met_once(rows, full), percent))
    discard(rows)
    rows = _mixed(clusters, found)
    marks = _may_meet(rows, about, percent, forest=False)
    near = rows.join(marks.toDF("key", "cls"), ["key", "cls"])
    found = _joined(found, _compared(_visiting(near, full, percent), percent))
    discard(rows, marks, clusters)
    return found


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links; both tables are replaced."""
    known = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    out = written(connected_components(known.union(links)), "class-groups")
    discard(found, links)
    return out


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, cls, size, component of the lists that hold several components."""
    told = members.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = told.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    return written(told.join(mixed, "key").select("key", "cls", "size", "component"), "mixed-lists")


def _met_once(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Every class in one block of its cluster."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
    home = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("n_blocks"))
    rows = rows.join(blocks, "key").withColumns({"home": home, "peer": home, "visitor": F.lit(False), "visits": F.lit(False)})
    return rows.join(full, "cls")


def _visiting(rows: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """All members in their blocks, with what `about` has of them; those outside
    the list's largest component also in every block of sizes that they may link
    with. Blocks are of one list and one bin of sizes; sizes that are two bins
    apart never link."""
    step = F.log(F.lit(100 / percent)) if percent < 100 else F.lit(1.0)
    size_bin = (F.floor(F.log("size") / step + 1e-9) if percent < 100 else F.col("size")).cast("bigint")
    rows = rows.withColumn("bin", size_bin)
    bins = rows.groupBy("key", "bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m")).select("key", F.col("m.component").alias("main"))
    rows = rows.join(main, "key").join(bins, ["key", "bin"]).join(about, "cls")
    rows = rows.withColumns({"visits": F.col("component") != F.col("main"), "home": F.col("bin") * _BINS_APART + F.pmod(F.xxhash64("cls"), "n_blocks")}).drop("main", "n_blocks")
    members = rows.withColumns({"peer": F.col("home"), "visitor": F.lit(False)})
    calls = rows.where("visits").withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).drop("bin")
    calls = calls.join(bins.withColumnRenamed("bin", "at"), ["key", "at"])
    calls = calls.withColumn("peer", F.explode(F.sequence(F.col("at") * _BINS_APART, F.col("at") * _BINS_APART + F.col("n_blocks") - 1)))
    calls = calls.where("peer <> home").withColumn("visitor", F.lit(True))
    return members.select(*_VISIT_ROWS, *about.drop("cls").columns).unionByName(calls.select(*_VISIT_ROWS, *about.drop("cls").columns))


#: Numbers of blocks of one bin lie below this.
_BINS_APART = 1 << 40
_VISIT_ROWS = ("key", "peer", "visitor", "home", "cls", "size", "component", "visits")


def _rows(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """id, mark (of the text), size, grp (a number for each group of linked
    classes, null without words), component (least id) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(col(key).alias("id"), col(text).cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sets_of = written(docs.mapInArrow(tidy(_classes(n)), f"id {kind}, mark bigint, size bigint, cls bigint"), "shingle-classes")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least")
    classes = written(sets_of.where("size > 0").groupBy("cls").agg(least, F.max("size").alias("size")).select("cls", "size", "least.id", "least.mark"), "classes")
    needed = F.ceil(F.col("size") * percent / 100)
    spread = classes.agg(F.sum(F.col("size") - needed + F.floor(F.col("size") / 8) + SURE)).first()[0] or 0
    n_buckets = 1 + int(spread) // BUCKET
    sent = docs.select("text").mapInArrow(tidy(_to_buckets("text", n, percent, n_buckets, GATHER)), "bucket int, kind int, a binary, b binary")
    parts = 1 + classes.count() // CREDITED
    met = written(sent.groupBy("bucket").applyInArrow(_meeting(FREQUENT, parts), "part int, a binary, b binary"), "met")
    summed = "id bigint, number bigint"
    shared = met.where("part >= 0").groupBy("part").applyInArrow(_sum_up, summed).select(F.col("id").alias("cls"), F.col("number").alias("shared"))
    sure = F.greatest(F.least(needed, F.lit(SURE)), F.floor(needed / 8))
    left = classes.join(shared, "cls").where(F.col("shared") >= sure).select("cls", F.col("id").alias("rep"), F.col("mark").alias("rep_mark"))
    texts = docs.join(left, docs["id"].eqNullSafe(left["rep"]) & (docs["mark"] == left["rep_mark"])).select("cls", "text")
    full = texts.mapInArrow(tidy(_full_sets("text", n)), "cls bigint, size bigint, shingles binary, bitmap binary")
    sets = written(full.dropDuplicates(["cls"]), "shingle-sets")
    often = met.where("part < 0").mapInArrow(_unpack, summed).orderBy(F.desc("number"), "id").limit(MAX_FREQUENT).collect()
    codes = np.array([r["id"] for r in often], np.int64).view(np.uint64)
    by = np.argsort(codes)
    frequent = spark.sparkContext.broadcast((codes[by], np.array([r["number"] for r in often], np.int64)[by]))
    posted = sets.mapInArrow(_postings(frequent, percent), "token bigint, bin bigint").groupBy("token", "bin").count()
    per_bin = posted.groupBy("token").agg(F.collect_list(F.struct("bin", "count")).alias("bins"), F.sum("count").alias("length"))     # a few hundred bins at most
    cost = per_bin.select(F.inline("bins"), "length").groupBy("bin").agg(F.sum("count"), F.sum(F.col("count") * F.col("length"))).collect()
    # a size beyond EXACT_SIZES counts as the largest of its bin
    binned = F.floor(F.pow(F.lit(2.0), (F.floor(12 * F.log2("size")) + 1) / 12)).cast("bigint")
    about = F.when(F.col("size") <= EXACT_SIZES, F.col("size")).otherwise(binned)
    sizes = {int(r[0]): int(r[1]) for r in sets.groupBy(about.alias("about")).count().collect()}
    boundary = choose_boundary([tuple(r) for r in cost], sizes, percent)
    keys = written(sets.mapInArrow(_keys(frequent, percent, boundary), "key bigint, cls bigint"), "keys")
    linked = _link_classes(sets, keys, percent)
    groups = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "id", F.coalesce("component", "cls").alias("component"))
    least = groups.groupBy("component").agg(F.min("id").alias("least"))
    of_class = written(groups.join(least, "component").select("cls", F.col("component").alias("grp"), F.col("least").alias("component")), "class-components")
    discard(met, sets, keys, classes, linked)
    return sets_of.join(of_class, "cls", "left").select("id", "mark", "size", "grp", F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: id (the key), size (distinct shingles of n
    words; a shorter text is one shingle), component (the least key reachable
    over links, its own included).

    Null and blank texts have size 0 and link with nothing: their component
    is their own key. Equal texts are one class, so repeated rows link; null
    keys are never the least unless all are null. Other columns are ignored;
    an empty table stays empty. Shingles and classes are told apart by 64-bit codes.
    """
    return _rows(docs, key, text, n, percent).select("id", "size", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows: the one with the least key (null
    last), of repeated rows with that key one. Rows without words all stay.
    Columns as in `docs`. A key may occur with several texts; each of them
    belongs to its own group."""
    found = written(_rows(docs, key, text, n, percent), "shingle-components")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    stay = found.where("size > 0").groupBy("grp").agg(first).select(F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    names = [free_name(docs, "stay"), free_name(docs, "stay_mark")]
    blank = found.where("size = 0").select("id", "mark")
    stay = written(stay.union(blank).distinct().toDF(*names), "staying")
    mark = F.xxhash64(col(text).cast("string"))
    kept = docs.join(stay, col(key).eqNullSafe(col(names[0])) & (mark == col(names[1])), "left_semi")
    if found.where("size > 0").groupBy("id", "mark").count().where("count > 1").limit(1).count():     # repeated rows
        words = F.coalesce(F.length(F.trim(F.translate(col(text), "\t\n\x0b\x0c\r", "     "))), F.lit(0)) > 0
        kept = kept.where(~words).unionByName(kept.where(words).dropDuplicates([key, text]))
    return kept.select(*map(col, docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs.select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
