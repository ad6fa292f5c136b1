"""Phrase collocations by direct-address tiling.

Phrases of 2 to `longest` words are counted level by level. In every task a
few MB of text at a time:

1. Words get ids in the order of their frequency; words that are not frequent
   in the whole corpus have none.
2. A phrase of k words is a pair (id of its first k - 1 words, id of its last).
   The plane of pairs is split into square tiles. Tiles with many pairs are
   counted in a dense array addressed by the pair itself; the others are
   counted as sorted coordinates.
3. Pairs that are frequent in the whole corpus are ranked again by frequency
   and become the first ids of the next level.

Pairs of words are counted twice: first by half of their code, packed, in
buckets, which leaves those that may be frequent; then, like all longer
phrases, by the phrase itself (a string), so counts are exact; a phrase is
frequent only if its parts are, so each level looks at the occurrences that
the level before left. What is frequent reaches the tasks as
a bit map of FILTER_BITS bits, whatever the corpus: where it lets an
infrequent phrase pass, the exact counts drop it later.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import textcodes
from staylens.llm.shared import col, small_batches, tidy, written

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: Text counted at once in a task.
GATHER_BYTES = 8 << 20
#: Ids along a tile's side, and pairs from which a tile is counted densely.
SIDE, DENSE = 1 << 10, 1 << 14
#: Pairs whose codes are counted in one bucket, at most, about.
BUCKET = 1 << 22
#: Bits of the map of frequent phrases: 8 MB, collected and broadcast.
LOG_BITS = 26
#: First step of the report: groups of phrases that are cut to their top rows.
SALTS = 32
NO_LANG = "und"

#: Piece ends [.,;:!?\x0A-\x0D], and what parts words (fixed values).
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False


# ---------------------------------------------------------------- pairs

def count_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each pair's kind, an occurrence of each kind, count of each kind).
    Ids are small where they are frequent; kinds come in no order."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    shift = SIDE.bit_length() - 1
    width = (int(y.max()) >> shift) + 1
    tile = (x >> shift) * width + (y >> shift)
    many = np.flatnonzero(np.bincount(tile) >= DENSE)
    kind = np.empty(len(x), np.int64)
    seen, counts, n = [], [], 0
    left = np.arange(len(x))
    if len(many):
        slot = np.full(int(tile.max()) + 1, -1, np.int64)
        slot[many] = np.arange(len(many))
        which = slot[tile]
        order = np.argsort(which, kind="stable")
        begin = np.searchsorted(which[order], np.arange(len(many) + 1))
        left = order[:begin[0]]
        for a, b in zip(begin[:-1], begin[1:]):
            at = order[a:b]
            cell = (x[at] & (SIDE - 1)) << shift | (y[at] & (SIDE - 1))
            count = np.bincount(cell, minlength=SIDE * SIDE)
            full = np.flatnonzero(count)
            place = np.empty(SIDE * SIDE, np.int64)
            place[cell] = at
            seen.append(place[full])
            counts.append(count[full])
            place[full] = np.arange(n, n + len(full))
            kind[at] = place[cell]
            n += len(full)
    if len(left):
        key = x[left] << 32 | y[left]
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        kind[left[order]] = n + np.cumsum(new) - 1
        first = np.flatnonzero(new)
        seen.append(left[order[first]])
        counts.append(np.diff(np.append(first, len(order))))
    return kind, np.concatenate(seen), np.concatenate(counts)


def ranked(kind: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of kinds replaced by their rank, the most frequent first."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return rank[kind]


# ---------------------------------------------------------------- texts in tasks

class Words:
    """Words of some texts: bytes, places, piece, text and code of each. A code
    holds the language, so ids are of (language, word)."""

    def __init__(self, texts: pa.Array, langs: list[str | None]):
        data, offsets = textcodes.joined(texts)
        self.data = textcodes.FOLD[data]
        self.starts, self.ends = textcodes.spans(self.data, WORD)
        self.piece = np.searchsorted(np.flatnonzero(ENDS[self.data]), self.starts)
        first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(first))
        self.langs = np.array([NO_LANG if x is None else x for x in langs], object)
        salts = {x: np.uint64(int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(self.langs)}
        salt = np.array([salts[x] for x in self.langs], np.uint64)
        self.codes = textcodes.combine(salt[self.text], textcodes.span_codes(self.data, self.starts, self.ends))

    def rows(self, at: np.ndarray, k: int, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """lang, phrase, code, n of the phrases of `k` words from these words on."""
        words = (at[:, None] + np.arange(k)).ravel()
        raw, offs = textcodes.gather(self.data, self.starts[words], self.ends[words])
        spaced = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.ascontiguousarray(offs[::k])), pa.py_buffer(raw)])
        phrase = pc.binary_slice(spaced, 0, -1).cast(pa.large_string()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(self.langs[self.text[at]], pa.string()), phrase, pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())],
            names=["lang", "phrase", "code", "n"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    held, size = [], 0
    for batch in batches:
        _, offs = textcodes.buffers(batch["text"])
        for i, j in textcodes.blocks(batch["text"], GATHER_BYTES):
            held.append(batch.slice(i, j - i))
            size += int(offs[j] - offs[i])
            if size >= GATHER_BYTES:
                both = pa.Table.from_batches(held)
                yield Words(both["text"], both["lang"].to_pylist())
                held, size = [], 0
    if held:
        both = pa.Table.from_batches(held)
        yield Words(both["text"], both["lang"].to_pylist())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for w in _gathered(batches):
        codes, at, counts = np.unique(w.codes, return_index=True, return_counts=True)
        yield w.rows(at, 1, codes, counts)


def _has(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes >> np.uint64(64 - LOG_BITS)
    return bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def phrase_counts(w: Words, k: int, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, code, count) of the phrases of `k` words whose parts, and
    with a map for `k` themselves, pass `frequent` (bit maps by length)."""
    some = np.flatnonzero(_has(frequent[0], w.codes))
    _, kind, counts = np.unique(w.codes[some], return_inverse=True, return_counts=True)
    last = np.full(len(w.codes) + 1, -1, np.int64)
    last[some] = ranked(kind, counts)
    ids, codes = last, w.codes
    for length in range(2, k + 1):
        end = np.arange(length - 1, len(w.codes))      # each phrase's last word
        at = end - length + 1
        fits = (ids[at] >= 0) & (last[end] >= 0) & (w.piece[at] == w.piece[end])
        if length > 2:
            fits &= ids[at + 1] >= 0
        at = at[fits]
        code = textcodes.combine(codes[at], w.codes[at + length - 1])
        if len(frequent) >= length:
            passed = _has(frequent[length - 1], code)
            at, code = at[passed], code[passed]
        kind, seen, counts = count_pairs(ids[at], last[at + length - 1])
        if length == k:
            return at[seen], code[seen], counts
        ids = np.full(len(w.codes) + 1, -1, np.int64)
        ids[at] = ranked(kind, counts)
        codes = np.zeros(len(w.codes), np.uint64)
        codes[at] = code
    raise ValueError("phrases have two words or more")


def _phrases(k: int, frequent: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [b.value for b in frequent]
        for w in _gathered(batches):
            at, codes, counts = phrase_counts(w, k, maps)
            yield w.rows(at, k, codes, counts)
    return tidy(run)


def _packed_pairs(words, n_buckets: int):
    """Pairs of words for `_often`: in each bucket, the upper halves of their
    codes and their counts, up to 255 (entries of one pair are split, not cut)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _gathered(batches):
            _, codes, counts = phrase_counts(w, 2, [words.value])
            times = -(-counts // 255)
            counts = np.repeat(counts, times)
            first = np.cumsum(times) - times
            left = counts - 255 * (np.arange(len(counts)) - np.repeat(first, times))
            codes = np.repeat(codes, times)
            bucket = (codes % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            upper, left = (codes[order] >> np.uint64(32)).astype("<u4"), np.minimum(left[order], 255).astype(np.uint8)
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), *(pa.array([x[ends[k]:ends[k + 1]].tobytes() for k in some], pa.binary()) for x in (upper, left))],
                names=["bucket", "upper", "counts"])
    return tidy(run)


def _often(min_count: int):
    """Codes (upper halves) of one bucket that occur `min_count` times or more."""
    def run(table: pa.Table) -> pa.Table:
        upper = np.frombuffer(b"".join(table["upper"].to_pylist()), "<u4")
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8)
        order = np.argsort(upper, kind="stable")
        first = np.flatnonzero(np.diff(upper[order].astype(np.int64), prepend=-1))
        total = np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
        codes = upper[order][first[total >= min_count]].astype(np.uint64) << np.uint64(32)
        return pa.table({"code": pa.array(codes.view(np.int64))})
    return run


# ---------------------------------------------------------------- counts in Spark

_ROWS = "lang string, phrase string, code bigint, n bigint"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase", "code").agg(F.sum("n").alias("n"))


def _bit_map(rows: DataFrame) -> np.ndarray:
    """A map of 2 ** LOG_BITS bits with those of the rows' codes set; at most
    2 ** LOG_BITS / 64 numbers reach the driver."""
    at = F.shiftrightunsigned("code", 64 - LOG_BITS)
    words = (rows.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(code, {64 - LOG_BITS}) & 63))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << LOG_BITS >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                     longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """([phrases of 1, 2, ... words: lang, phrase, n], totals: lang, n), exact.

    Words are lower-cased (A-Z) and counted per language (null: `und`), phrases
    within pieces; null and empty texts have none. Two words of a language with
    one code would be counted as one; that is looked for over all words, and
    raises."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
    words = written(_summed(source.mapInArrow(tidy(_words), _ROWS)), "collocation-words")
    clash = words.groupBy("lang", "code").agg(F.count(F.lit(1)).alias("words")).where("words > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two words of {clash[0]['lang']} have one code")
    levels = [words.where(F.col("n") >= min_count)]
    maps: list = []
    for k in range(2, longest + 1):
        maps.append(spark.sparkContext.broadcast(_bit_map(levels[-1])))
        passing = list(maps)
        if k == 2:      # most pairs occur once or twice: a packed count of their codes sorts them out
            n_buckets = 1 + int(words.agg(F.sum("n")).first()[0] or 0) // BUCKET
            packed = source.mapInArrow(_packed_pairs(maps[0], n_buckets), "bucket bigint, upper binary, counts binary")
            often = packed.groupBy("bucket").applyInArrow(_often(min_count), "code bigint")
            passing.append(spark.sparkContext.broadcast(_bit_map(often)))
        counted = _summed(source.mapInArrow(_phrases(k, passing), _ROWS)).where(F.col("n") >= min_count)
        levels.append(written(counted, "collocation-phrases"))
    return [x.select("lang", "phrase", "n") for x in levels], words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 longest: int = LONGEST, absorbed: int = 100, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    The score of a cut is floor(1000 * a * n / (l * r)) for a phrase that occurs
    a times, its two parts l and r times, among n words; the least of a phrase's
    cuts counts, the first of equal ones. A phrase inside a longer one with
    100 * f(longer) >= absorbed * a goes. Equal scores are ranked by a, then by
    the phrase. Empty tables, and languages without frequent phrases, have no
    rows; repeated documents count each time; other columns are not read.
    """
    levels, totals = frequent_phrases(docs, text, lang, min_count, longest)
    known = reduce(DataFrame.unionByName, levels)
    phrases = reduce(DataFrame.unionByName, levels[1:]).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.size("w")

    def part(start, n):
        return F.array_join(F.slice("w", start, n), " ")

    # a phrase of k words inside a longer one is inside one of k + 1 words that occurs as often or more
    inner = F.explode(F.when(size > 2, F.array(part(1, size - 1), part(2, size - 1))))
    longer = phrases.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {absorbed} * a").drop("longer")
    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"), "w")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, size - F.col("cut")).alias("tail"))
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
            .join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
            .join(totals, "lang"))
    wide = "CAST({} AS DECIMAL(38, 0))".format
    score = F.expr(f"({wide(1000)} * {wide('a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    """op11: the first 2000 phrases of each language."""
    return collocations(docs)
