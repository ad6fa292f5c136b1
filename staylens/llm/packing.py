"""Sequence packing by best-fit decreasing over window capacities.

A document's ids are cut into full windows; what is left is shorter than a
window. Only the number of pieces of each length decides the plan, so the
plan is made from one small histogram (at most `window` rows): lengths in
decreasing order, each put into the open windows with the tightest room,
found with a segment tree over remaining capacities. Windows with equal
contents are handled together, so the plan has a few segments per length,
however many documents there are. Pieces then take their place by their
ordinal within their length, counted per task and offset per task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import tokens
from staylens.llm.shared import col, small_batches, tidy, written

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2


class CapacityTree:
    """Segment tree over capacities 0..n: is any window open with that room left?"""

    def __init__(self, n: int):
        self.size = 1 << max(1, n).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, windows: int) -> None:
        k = capacity + self.size
        while k:
            self.open[k] += windows
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest capacity >= need with an open window."""
        k = need + self.size
        if self.open[k]:
            return need
        while k > 1:
            if not k & 1 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for pieces given as {length: how many}.

    Returns segments (length, first ordinal, first window, pieces per window,
    offset): the pieces of that length from that ordinal on fill windows one
    after another, that many to a window, from that offset.
    """
    tree = CapacityTree(window)
    rooms: dict[int, deque[tuple[int, int]]] = defaultdict(deque)   # room left -> (first window, windows)
    out: list[tuple[int, int, int, int, int]] = []
    n_windows = 0

    def put(first: int, windows: int, room: int) -> None:
        if windows and room:
            rooms[room].append((first, windows))
            tree.add(room, windows)

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, ordinal = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = window, n_windows
                windows = -(-left // (window // length))
                n_windows += windows
            else:
                first, windows = rooms[room].popleft()
                tree.add(room, -windows)
            each = room // length
            full = min(windows, left // each)
            if full:
                out.append((length, ordinal, first, each, window - room))
                put(first, full, room - each * length)
                ordinal, left = ordinal + full * each, left - full * each
            if full < windows and left:          # one window takes the rest of this length
                out.append((length, ordinal, first + full, left, window - room))
                put(first + full, 1, room - left * length)
                ordinal, left, full = ordinal + left, 0, full + 1
            if full < windows:
                rooms[room].appendleft((first + full, windows - full))
                tree.add(room, windows - full)
    return out


def padded_length(used: int, window: int = WINDOW) -> int:
    """Length of a sequence in storage: the window, or its own length at a power of two."""
    return used if used & (used - 1) == 0 else window


def _cut(key: str, text: str, vocabulary: str, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.word_ids(vocabulary)
        seen = np.zeros(window + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[int] = []
            start, length, crc, total, rank, ids_out = [], [], [], [], [], []
            flat, offsets = words.encode_column(batch[text])
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                ids = np.append(flat[a:b], words.dtype.type(end_id)).astype("<u4")
                for s in range(0, len(ids), window):
                    piece = ids[s:s + window]
                    rows.append(row)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    rank.append(int(seen[len(piece)]))
                    seen[len(piece)] += 1
                    ids_out.append(piece.tobytes() if with_ids else None)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total, [part] * len(rows), rank)]
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(rows, pa.int64())), *numbers, pa.array(ids_out, pa.binary())],
                                             names=[key, "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"])
    return run


def _place(key: str, segments, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments.value
        where, first_ordinal, first_window, each, base = table["key"], table["ordinal"], table["window"], table["each"], table["offset"]
        for batch in batches:
            length = batch["length"].to_numpy()
            ordinal = batch["rank"].to_numpy() + batch["before"].to_numpy()
            k = np.searchsorted(where, length * (1 << 48) + ordinal, "right") - 1
            nth = ordinal - first_ordinal[k]
            out = {"sequence_id": first_window[k] + nth // each[k], "offset": base[k] + nth % each[k] * length}
            yield pa.RecordBatch.from_arrays([batch[c] for c in (key, "start", "length", "ids_crc32", "doc_tokens")]
                                             + [pa.array(v, pa.int64()) for v in out.values()] + [batch["ids"]],
                                             names=[key, "start", "length", "ids_crc32", "doc_tokens", *out, "ids"])
    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens.

    One row per piece: the key, start (ids of its document before it),
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, and ids (those bytes, when `with_ids`). Sequence ids
    run from 0 without gaps, and so do the offsets within a sequence.

    Null and empty texts are one piece with the end id; repeated rows are
    each packed; other columns are dropped; an empty table packs to none.
    A sequence is stored padded to the window, except at a power of two
    (`padded_length`).
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, rank bigint, ids binary"
    cut = written(docs.select(col(key), col(text)).mapInArrow(tidy(_cut(key, text, vocabulary, window, end_id, with_ids)), schema), "pieces")
    counts = written(cut.groupBy("part", "length").count(), "piece-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = sorted(plan(histogram, window))         # at most a few per length
    segments = {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "ordinal", "window", "each", "offset"))}
    segments["key"] = segments["length"] * (1 << 48) + segments["ordinal"]
    held = spark.sparkContext.broadcast(segments)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return cut.join(before, ["part", "length"]).mapInArrow(_place(key, held, window), schema)


def sequences(packed: DataFrame, window: int = WINDOW, padding: int = 0) -> DataFrame:
    """The sequences of `pack(..., with_ids=True)`: sequence_id, used (ids before
    the padding), n_pieces, ids (little-endian unsigned 32-bit, padded to the
    window, except at a power of two). A group is one sequence, `window` ids at
    most."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(pieces, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n_pieces"), whole.alias("ids"))
    stored = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, F.col("used")).otherwise(F.lit(window))
    fill = F.lit(padding.to_bytes(4, "little"))
    return rows.withColumn("ids", F.rpad(F.col("ids"), (stored * 4).cast("int"), fill))


def digest(docs: DataFrame) -> DataFrame:
    """op3: the placement of every piece."""
    return pack(docs).drop("ids")
