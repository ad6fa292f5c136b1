"""Removal of passages that repeat anywhere in the corpus.

A passage is `window` consecutive words of one document; it repeats when the
same words also start anywhere else, in the same document included. Steps:

1. Rows are packed into shards of a few MB (each a written row, so every
   later pass and every retry sees the same shards).
2. Anchors: of the shorter word sequences inside a window, the one of least
   code. Equal windows have equal anchors at the same place, and neighbouring
   windows share theirs, so there are about a twelfth as many anchors as
   words. Anchors that occur once rule their windows out.
3. Confirming: the codes (96 bits) of the remaining windows are counted.
   Keys of a shard are folded there, then meet in buckets by their code, and
   each bucket names the recurring ones back to the shards that sent them.
   Anchors are counted in the same way.
4. Each shard compiles the recurring passages of its documents into
   Aho-Corasick automata of bounded size and streams the documents through
   them; what they locate is removed.

A passage in a third of all documents is one key per shard in one bucket; a
shard meets only the buckets' answers for its own keys. Nothing is broadcast
or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm import textcodes
from staylens.llm.shared import col, free_name, numbered, open_fs, shared_path, small_batches, tidy, written

WINDOW = 35
#: Text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 2 << 20
#: Rows in a shard, at most.
SHARD_ROWS = 1 << 14
#: Text whose keys meet in one bucket, about.
BUCKET_BYTES = 16 << 20
#: Text compiled into one automaton, about.
PATTERN_BYTES = 1 << 20
#: Windows in one pattern, at most; longer passages are cut, with overlap.
PATTERN_WINDOWS = 2048
#: Bytes of shards handed to a task at once.
HANDED_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
_KEY = np.dtype([("code", "<u8"), ("check", "<u4"), ("place", "<u4")])
#: In `place`: the key occurs more than once in its shard.
_MANY = np.uint32(1 << 31)
_OTHER = np.uint64(0xD1B54A32D192ED03)


# ---------------------------------------------------------------- shards

def _packer(text: str):
    def pack(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size], pa.int64())], names=["payload", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in batches:
            _, offs = textcodes.buffers(batch[text])
            for i, j in textcodes.blocks(batch[text], SHARD_BYTES):
                n = int(offs[j] - offs[i])
                if held and (size + n > SHARD_BYTES or rows + j - i > SHARD_ROWS):
                    yield pack(held, size)
                    held, size, rows = [], 0, 0
                held.append(batch.slice(i, j - i))
                size, rows = size + n, rows + j - i
        if held:
            yield pack(held, size)
    return tidy(run)


class Shard:
    """Words of a shard's texts; `first`: each text's first word, and the end."""

    def __init__(self, payload: bytes, text: str):
        self.rows = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.data, offsets = textcodes.joined(self.rows[text])
        self.starts, self.ends = textcodes.spans(self.data, textcodes.NOT_SPACE)
        self.first = np.searchsorted(self.starts, offsets)


class Windows:
    """Codes of a shard's windows and their anchors."""

    def __init__(self, shard: Shard, window: int):
        gram = max(1, window // 3)
        n = max(0, len(shard.starts) - window + 1)
        text_of = np.repeat(np.arange(len(shard.first) - 1), np.diff(shard.first))
        self.inside = text_of[:n] == text_of[window - 1:window - 1 + n]     # of one text
        codes = textcodes.span_codes(shard.data, shard.starts, shard.ends)
        self.codes = codes
        grams = textcodes.gram_codes(codes, gram)
        self.anchor = _sliding(grams, window - gram + 1, np.minimum)       # of each window
        # a sequence is an anchor where it is the least of a window around it
        least = np.where(self.inside, self.anchor, np.uint64(0))
        pad = np.zeros(window - gram, np.uint64)
        chosen = _sliding(np.concatenate([pad, least, pad]), window - gram + 1, np.maximum) == grams if n else np.empty(0, bool)
        self.anchors = grams[:len(chosen)][chosen]
        self.window = window

    def candidates(self, recurring: np.ndarray) -> np.ndarray:
        """Places of windows whose anchor is one of `recurring` (sorted)."""
        at = np.minimum(np.searchsorted(recurring, self.anchor), max(0, len(recurring) - 1))
        return np.flatnonzero(self.inside & (recurring[at] == self.anchor)) if len(recurring) else np.empty(0, np.int64)

    def keys(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, check) of the windows at these places."""
        code = textcodes.gram_codes(self.codes, self.window)[places]
        check = textcodes.gram_codes(textcodes.mix(self.codes ^ _OTHER), self.window)[places]
        return code, (check >> np.uint64(32)).astype(np.uint32)


def _sliding(x: np.ndarray, w: int, least) -> np.ndarray:
    """Minimum (or maximum) of the `w` values from each place on."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x, have = least(x[:-have], x[have:]), have * 2
    return least(x[:-(w - have)], x[w - have:]) if w > have else x


def _distinct(code: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each distinct key in that order, number of the key of each)."""
    order = np.lexsort((check, code))
    new = np.ones(len(order), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (check[order][1:] != check[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


# ---------------------------------------------------------------- counting keys

def _asked(shard: int, code: np.ndarray, check: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A shard's distinct keys, a row for each bucket."""
    order, first, _ = _distinct(code, check)
    keys = np.empty(len(first), _KEY)
    keys["code"], keys["check"] = code[order][first], check[order][first]
    many = np.diff(np.append(first, len(order))) > 1
    keys["place"] = np.arange(len(first), dtype=np.uint32) | np.where(many, _MANY, np.uint32(0))
    bucket = (keys["code"] % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    offsets = np.append(begin, len(by)) * _KEY.itemsize
    blobs = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(keys[by].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int64()), pa.array(np.full(len(begin), shard), pa.int64()), blobs.cast(pa.binary())],
                                      names=["bucket", "shard", "keys"])


def _count(table: pa.Table) -> pa.Table:
    """A bucket: for each shard, the places of its keys that occur again."""
    blobs = table["keys"].to_pylist()
    keys = np.frombuffer(b"".join(blobs), _KEY)
    sender = np.repeat(np.arange(len(blobs)), [len(b) // _KEY.itemsize for b in blobs])
    order, first, number = _distinct(keys["code"], keys["check"])
    sizes = np.diff(np.append(first, len(order)))
    many = np.maximum.reduceat(keys["place"][order] & _MANY, first) > 0 if len(first) else np.empty(0, bool)
    found = np.flatnonzero(((sizes > 1) | many)[number])      # in the senders' order
    places = keys["place"][found] & ~_MANY
    begin = np.searchsorted(sender[found], np.arange(len(blobs) + 1))
    some = np.flatnonzero(np.diff(begin))
    shards = table["shard"].to_numpy()
    return pa.table({"shard": pa.array(shards[some], pa.int64()),
                     "found": pa.array([places[begin[k]:begin[k + 1]].tobytes() for k in some], pa.binary())})


def _recurring(asked: DataFrame, name: str) -> str:
    """Folder with, for each shard, the places of its keys that occur again.
    Shards of one folder `at` are those written by one task, 256 at most."""
    found = asked.groupBy("bucket").applyInArrow(_count, "shard bigint, found binary")
    path = shared_path(asked.sparkSession, name)
    (found.withColumn("at", F.col("shard").bitwiseAND(~0xFF)).repartition("at").sortWithinPartitions("at", "shard")
     .write.partitionBy("at").parquet(path))
    return path


class _Answers:
    """What `_recurring` wrote, read shard by shard in a task."""

    def __init__(self, path: str):
        self.fs, self.path = open_fs(path)
        self.at, self.held = None, {}

    def of(self, shard: int) -> np.ndarray:
        if shard & ~0xFF != self.at:
            self.at, self.held = shard & ~0xFF, {}
            folder = f"{self.path}/at={self.at}"
            if self.fs.get_file_info(folder).type != pa.fs.FileType.NotFound:
                files = [f.path for f in self.fs.get_file_info(pa.fs.FileSelector(folder)) if f.path.endswith(".parquet")]
                for f in files:
                    rows = pq.ParquetFile(self.fs.open_input_file(f)).read(columns=["shard", "found"])
                    for s, b in zip(rows["shard"].to_pylist(), rows["found"].to_pylist()):
                        self.held.setdefault(s, []).append(b)
        return np.sort(np.frombuffer(b"".join(self.held.get(shard, ())), "<u4"))


def _shards_of(batches: Iterator[pa.RecordBatch], text: str, window: int):
    for batch in batches:
        for row in range(batch.num_rows):
            shard = Shard(batch["payload"][row].as_py(), text)
            yield batch["shard"][row].as_py(), shard, Windows(shard, window)


def _anchors(text: str, window: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, w in _shards_of(batches, text, window):
            yield _asked(number, w.anchors, np.zeros(len(w.anchors), np.uint32), n_buckets)
    return tidy(run)


def _candidates(w: Windows, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, codes, checks) of the windows whose anchor recurs."""
    places = w.candidates(np.unique(w.anchors)[answer])
    return places, *w.keys(places)


def _windows(text: str, window: int, n_buckets: int, anchors: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = _Answers(anchors)
        for number, _, w in _shards_of(batches, text, window):
            _, code, check = _candidates(w, answers.of(number))
            yield _asked(number, code, check, n_buckets)
    return tidy(run)


# ---------------------------------------------------------------- automata

def _passages(recurs: np.ndarray, first: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """(first word, end) of each text's runs of recurring windows, long ones cut."""
    opens = np.zeros(len(recurs) + 1, bool)
    opens[first[first < len(recurs)]] = True
    on = np.append(recurs, False)
    before = np.concatenate([[False], recurs])
    begin = np.flatnonzero(on & (~before | opens))
    end = np.flatnonzero(before & (~on | opens))
    for a, b in zip(begin.tolist(), end.tolist()):
        for at in range(a, b, PATTERN_WINDOWS):
            yield at, min(at + PATTERN_WINDOWS, b) + window - 1


def locate(words: bytes, offsets: np.ndarray, first: np.ndarray, recurs: np.ndarray, window: int) -> np.ndarray:
    """Which words stand in an occurrence of a recurring passage.

    `words`: a space, then each word with a space behind it; word k starts at
    offsets[k] + 1; `first`: each text's first word, and the end. The passages
    are compiled in turn into automata of about PATTERN_BYTES; each streams
    the stretch of texts that its passages come from."""
    import ahocorasick

    change = np.zeros(len(offsets), np.int64)

    def stream(passages: list[tuple[int, int]]) -> None:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for a, b in passages:
            automaton.add_word(words[offsets[a]:offsets[b] + 1].decode("latin-1"))
        automaton.make_automaton()
        lo, hi = passages[0][0], max(b for _, b in passages)
        edges = first[(first > lo) & (first < hi)].tolist()
        for a, b in zip([lo, *edges], [*edges, hi]):
            found = np.array(list(automaton.iter(words[offsets[a]:offsets[b] + 1].decode("latin-1"))), np.int64).reshape(-1, 2)
            ends = found[:, 0] + int(offsets[a])                    # the space behind the passage
            np.add.at(change, np.searchsorted(offsets, ends - found[:, 1] + 1), 1)
            np.add.at(change, np.searchsorted(offsets, ends), -1)

    held, size = [], 0
    for a, b in _passages(recurs, first, window):
        held.append((a, b))
        size += int(offsets[b] - offsets[a])
        if size >= PATTERN_BYTES:
            stream(held)
            held, size = [], 0
    if held:
        stream(held)
    return np.cumsum(change[:-1]) > 0


def _remover(text: str, window: int, anchors: str, windows: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_anchors, from_windows = _Answers(anchors), _Answers(windows)
        for number, shard, w in _shards_of(batches, text, window):
            places, code, check = _candidates(w, from_anchors.of(number))
            answer = from_windows.of(number)
            recurs = np.zeros(len(w.inside), bool)
            if len(answer):
                _, first, which = _distinct(code, check)
                again = np.zeros(len(first), bool)
                again[answer] = True
                recurs[places[again[which]]] = True
            n_words = np.diff(shard.first)
            gone = np.zeros(len(shard.starts), bool)
            if recurs.any():
                joined, offs = textcodes.gather(shard.data, shard.starts, shard.ends)
                gone = locate(b" " + joined.tobytes(), offs, shard.first, recurs, window)
            kept, offs = textcodes.gather(shard.data, shard.starts[~gone], shard.ends[~gone])
            before = np.concatenate([[0], np.cumsum(~gone)])[shard.first]      # kept words before each text
            begin, end = offs[before[:-1]], offs[before[1:]]
            end = np.maximum(begin, end - 1)                                   # no space behind the last
            raw = kept.tobytes()
            texts = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.large_binary()).cast(pa.string())
            result = pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(before), pa.int64()), texts], names=["n_words", "n_removed", "kept"])
            for batch in shard.rows.append_column(out, result).to_batches():
                yield batch
    return tidy(run)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, str]:
    """Documents with what is left when every word inside a recurring passage is
    taken out. Returns (documents, name of the added column); the column is a
    struct of n_words and n_removed (long) and kept (string, the remaining
    words joined by one space). Words are runs of characters other than ASCII
    white space, compared as they are.

    Null and empty texts have no words and keep none; a repeated row repeats
    all its passages, so both copies lose them; texts of fewer words than
    `window` lose nothing; keys do not matter and may be null or repeated; all
    other columns stay, and the added column gets a free name; an empty table
    stays empty. A text of any length is held whole by one task, with about 25
    bytes of working memory a byte.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if spark.conf.get(HANDED_BYTES, None) in (None, str(256 << 20), str(64 << 20)):
        spark.conf.set(HANDED_BYTES, str(4 * SHARD_BYTES))
    out, names = free_name(docs, "repeats"), docs.columns
    docs, (text,) = numbered(docs, text)
    packed = docs.mapInArrow(_packer(text), "payload binary, bytes bigint")
    shards = written(packed.select(F.monotonically_increasing_id().alias("shard"), "payload", "bytes"), "repeat-shards")
    n_buckets = max(1, -(-(shards.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    asked = "bucket bigint, shard bigint, keys binary"
    rows = shards.select("shard", "payload")
    anchors = _recurring(rows.mapInArrow(_anchors(text, window, n_buckets), asked), "repeat-anchors")
    windows = _recurring(rows.mapInArrow(_windows(text, window, n_buckets, anchors), asked), "repeat-windows")
    schema = T.StructType([*docs.schema.fields, T.StructField("repeats", RESULT)])
    return rows.mapInArrow(_remover(text, window, anchors, windows, "repeats"), schema).toDF(*names, out), out


def digest(docs: DataFrame) -> DataFrame:
    """op13: per document, its words, how many are removed, and the SHA-256 of the kept text."""
    found, name = remove_repeats(docs.select("doc_id", "text"))
    r = col(name)
    return found.select("doc_id", r["n_words"].alias("n_words"), r["n_removed"].alias("n_removed"),
                        F.sha2(r["kept"].cast("binary"), 256).alias("kept_sha256"))
