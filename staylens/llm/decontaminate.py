"""Benchmark decontamination with suffix arrays over the training shards.

Every task cuts its documents into shards of bounded size and sorts the
suffixes of each shard's words (prefix doubling, as deep as the longest
benchmark item). All suffixes of all benchmark items are then searched at
once by vectorised binary search, which yields the occurrences of every
window and the longest verbatim match of each document with its place.
Only the benchmark is broadcast, in blocks of bounded size; each further
block is one more pass over the documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import textcodes
from staylens.llm.shared import col, free_name, small_batches, tidy, written

WINDOW = 10
#: Bytes of document text in one suffix array, and of benchmark text in one broadcast.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20

HIT = "struct<start:bigint,length:bigint>"
REPORT = (f"struct<n_words:bigint,n_hit:bigint,longest:bigint,longest_at:bigint,longest_item:string,"
          f"items:array<string>,hits:array<{HIT}>>")
_HIT = pa.struct([("start", pa.int64()), ("length", pa.int64())])


@dataclass
class Block:
    """Benchmark items that are searched together."""

    codes: np.ndarray      # word codes of all items, one after another
    first: np.ndarray      # number of each item's first word, plus the end
    names: list[str]

    def queries(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every suffix of every item: its place, words left, item, window length."""
        size = np.diff(self.first)
        item = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(self.codes))
        return place, self.first[1:][item] - place, item, np.minimum(window, size[item])


def suffix_order(seq: np.ndarray, bits: int, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `seq` in order of their first `depth` codes (equal ones stay
    together; what follows a separator, code 0, is not compared), and the first
    two codes of each as one key. `stop`: place of the next separator."""
    n = len(seq)
    follow = np.zeros(n, np.uint64)
    follow[:-1] = seq[1:]
    index_bits = max(1, int(n - 1).bit_length())
    packed = (((seq << np.uint64(bits)) | follow) << np.uint64(index_bits)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << index_bits) - 1)).astype(np.int64)
    keys = packed >> np.uint64(index_bits)
    del packed, follow
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 2
    slots = np.arange(n)
    while h < depth and len(slots):
        fresh = new[slots]
        last = np.ones(len(slots), bool)      # the slot ends its group
        last[:-1] = fresh[1:] | (slots[1:] != slots[:-1] + 1)
        at = order[slots]
        slots = slots[~(fresh & last) & (stop[at] - at >= h)]
        if not len(slots):
            break
        at = order[slots]
        group, then = rank[at], rank[np.minimum(at + h, n)]
        by = np.lexsort((then, group)) if n >= 1 << 31 else np.argsort((group << 32) | (then + 1), kind="stable")
        at, group, then = at[by], group[by], then[by]
        order[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        new[slots] |= fresh
        starts = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[at] = slots[starts]
        h *= 2
    return order, keys


def _bound(seq: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
    """Per query: the first slot in [lo, hi) whose code `depth` words in is at least `want`."""
    lo, hi = lo.copy(), hi.copy()
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        go = lo < hi
        less = go & (seq[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(seq) - 1)] < want)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(go & ~less, mid, hi)
    return lo


def search(codes: np.ndarray, first: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in `codes`, place in the block) of every occurrence of a window.

    `codes`, `first`: words of a shard's documents and each one's first word."""
    n_docs = len(first) - 1
    n = len(codes) + n_docs
    none = np.empty(0, np.int64)
    if not len(codes) or not len(block.codes):
        return none, none
    bits = min(21, (64 - max(1, int(n - 1).bit_length())) // 2)

    def short(x: np.ndarray) -> np.ndarray:
        return np.maximum(x >> np.uint64(64 - bits), np.uint64(1))

    doc = np.repeat(np.arange(n_docs), np.diff(first))
    seq = np.zeros(n + 1, np.uint64)
    seq[np.arange(len(codes)) + doc] = short(codes)
    stop = np.repeat(first[1:] + np.arange(n_docs), np.diff(first) + 1)
    place, left, _, wide = block.queries(window)
    order, keys = suffix_order(seq[:n], bits, stop, int(left.max()))
    q = short(block.codes)
    whole = left >= wide                       # a window starts here
    place, left, wide = place[whole], left[whole], wide[whole]
    head = q[place] << np.uint64(bits)
    second = q[np.minimum(place + 1, len(q) - 1)]
    lo = np.searchsorted(keys, np.where(wide > 1, head | second, head), "left")
    hi = np.searchsorted(keys, np.where(wide > 1, head | second, head | np.uint64((1 << bits) - 1)), "right")
    for d in range(2, int(wide.max())):
        more = (lo < hi) & (wide > d)
        if not more.any():
            break
        k = np.flatnonzero(more)
        want = q[place[k] + d]
        left_edge = _bound(seq, order, lo[k], hi[k], d, want)
        hi[k] = _bound(seq, order, left_edge, hi[k], d, want + np.uint64(1))
        lo[k] = left_edge
    size = hi - lo
    which = np.repeat(np.arange(len(size)), size)
    slot = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    at = order[slot]
    at = at - np.searchsorted(first[1:] + np.arange(n_docs), at)      # back to places in codes
    came = place[which]
    good = np.ones(len(at), bool)
    for k in range(int(wide.max())):           # exact check on the full codes
        near = good & (wide[which] > k)
        good[near] = codes[at[near] + k] == block.codes[came[near] + k]
    return at[good], came[good]


def _longest(codes, first, doc, at, came, block, item_end):
    """Per occurrence: words in common from there on, inside document and item."""
    length = np.zeros(len(at), np.int64)
    alive = np.arange(len(at))
    room = np.minimum(first[doc + 1] - at, item_end - came)
    k = 0
    while len(alive):
        alive = alive[room[alive] > k]
        alive = alive[codes[at[alive] + k] == block.codes[came[alive] + k]]
        length[alive] = k + 1
        k += 1
    return length


def _report(codes, first, block, window, prior) -> pa.StructArray:
    n_docs = len(first) - 1
    at, came = search(codes, first, block, window)
    doc = np.searchsorted(first, at, "right") - 1
    item = np.searchsorted(block.first, came, "right") - 1
    size = np.diff(block.first)
    wide = np.minimum(window, size[item])
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + wide, -1)
    found: dict[int, set[str]] = {}
    for d, i in np.unique(np.stack([doc, item], 1), axis=0) if len(doc) else ():
        found.setdefault(int(d), set()).add(block.names[i])
    length = _longest(codes, first, doc, at, came, block, block.first[item + 1])
    best, best_at, best_item = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), [None] * n_docs
    for k in np.lexsort((at, -length, doc)):
        d = int(doc[k])
        if not best[d]:
            best[d], best_at[d], best_item[d] = length[k], at[k] - first[d], block.names[item[k]]
    if prior is not None:                      # what earlier blocks found
        for d, old in enumerate(prior.to_pylist()):
            for x in old["hits"]:
                marks[first[d] + x["start"]] += 1
                marks[first[d] + x["start"] + x["length"]] -= 1
            if old["items"]:
                found.setdefault(d, set()).update(old["items"])
            if old["longest"] >= best[d]:
                best[d], best_at[d], best_item[d] = old["longest"], old["longest_at"], old["longest_item"]
    hit = np.cumsum(marks[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    edge = np.ones(len(codes), bool)
    edge[1:] = hit[1:] != hit[:-1]
    edge[first[:-1][first[:-1] < len(codes)]] = True
    run = np.flatnonzero(edge)
    ends = np.append(run[1:], len(codes))
    keep = hit[run] if len(run) else np.empty(0, bool)
    run, ends = run[keep], ends[keep]
    owner = np.searchsorted(first, run, "right") - 1
    hits = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(n_docs + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(run - first[owner], pa.int64()), pa.array(ends - run, pa.int64())], fields=list(_HIT)))
    columns = [np.diff(first), total[first[1:]] - total[first[:-1]], best, best_at]
    return pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in columns]
        + [pa.array(best_item, pa.string()), pa.array([sorted(found.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())), hits],
        names=["n_words", "n_hit", "longest", "longest_at", "longest_item", "items", "hits"])


def _searcher(text: str, report: str, keep: list[str], block, window: int, prior: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def shard(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            texts = rows[text].combine_chunks() if rows[text].num_chunks != 1 else rows[text].chunk(0)
            data, offsets = textcodes.buffers(texts)
            codes, first = textcodes.word_codes(data, offsets, textcodes.ALNUM)
            before = rows[report].combine_chunks() if prior else None
            if isinstance(before, pa.ChunkedArray):
                before = before.chunk(0)
            out = _report(codes, first.astype(np.int64), block.value, window, before)
            cols = [rows[c].combine_chunks() for c in keep]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            return pa.RecordBatch.from_arrays([*cols, out], names=[*keep, report])

        for batch in batches:
            for i, j in textcodes.blocks(batch[text], SHARD_BYTES):
                part = batch.slice(i, j - i)
                held.append(part)
                size += part[text].nbytes
                if size >= SHARD_BYTES:
                    yield shard(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield shard(pa.Table.from_batches(held))

    return run


def _blocks(benchmark: DataFrame, text: str, item: str) -> Iterator[Block]:
    """The benchmark's items in broadcasts of at most BLOCK_BYTES of text (or one item)."""
    rows: list[tuple[str, str]] = []
    size = 0

    def pack() -> Block:
        data, offsets = textcodes.buffers(pa.array([r[1] for r in rows], pa.large_string()))
        codes, first = textcodes.word_codes(data, offsets, textcodes.ALNUM)
        return Block(codes, first.astype(np.int64), [r[0] for r in rows])

    frame = benchmark.select(col(item).cast("string"), col(text)).where(col(text).isNotNull())
    for name, words in frame.toLocalIterator():
        if rows and size + len(words) > BLOCK_BYTES:
            yield pack()
            rows, size = [], 0
        rows.append((str(name), words))
        size += len(words)
    yield pack()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", benchmark_text: str = "text",
                  item: str = "item_id", window: int = WINDOW, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Matches of every document against every benchmark item.

    Returns the `keep` columns (default: all) of `docs` plus one struct
    column, and that column's name ("contamination", with underscores added
    if `docs` has it already): n_words, n_hit (words inside an occurrence of
    a window), longest / longest_at / longest_item (the longest verbatim
    match, in words, that contains a window), items (with an occurring
    window, sorted as strings) and hits (disjoint runs of hit words).

    A window is `window` consecutive words of an item; an item of fewer, but
    not none, is one window. Null and empty texts have no words and no hits;
    repeated rows are each reported; equal items are each reported; a null
    item id reads "None". An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = list(docs.columns) if keep is None else list(keep)
    report = free_name(docs, "contamination")
    frame = docs
    for i, block in enumerate(_blocks(benchmark, benchmark_text, item)):
        if i:
            frame = written(frame, "decontamination")
        held = spark.sparkContext.broadcast(block)
        cols = list(dict.fromkeys([*keep, text]))
        fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols]
        source = frame.select(*map(col, cols), *([col(report)] if i else []))
        frame = source.mapInArrow(tidy(_searcher(text, report, cols, held, window, i > 0)), ", ".join([*fields, f"`{report}` {REPORT}"]))
    return frame.select(*map(col, keep), col(report)), report


def digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest match."""
    found, c = decontaminate(docs.select(key, "text"), benchmark, keep=[key])
    r = F.col(c)
    return found.select(key, r["n_words"].alias("n_words"), r["n_hit"].alias("n_hit"),
                        F.size(r["items"]).cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", r["items"]).cast("binary"), 256).alias("items_sha256"),
                        (r["n_hit"] > 0).alias("contaminated"),
                        r["longest"].alias("longest_match"), r["longest_at"].alias("longest_at"))
