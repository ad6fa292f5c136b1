"""Token-id files compressed by a Re-Pair grammar.

A file holds blocks of ids. In each block, frequent pairs of neighbouring
symbols are replaced by new symbols, round by round. The block stores the
rules, every symbol's expansion length and the remaining sequence; prefix
sums of the expansion lengths lead from an id's place to the symbol that
covers it, so any range decodes without the rest of the block.

Layout (little-endian): MAGIC; blocks; then per block (offset u64, ids u64,
documents u64); number of blocks u64; MAGIC. A block: seven u64 (documents,
ids, terminals, rules, symbols, bytes of keys, crc32 of the rest), document
lengths u64, terminals u32, rules 2 x u32, expansion lengths u64, symbols u16
or u32, document keys as an Arrow stream.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import tokens
from staylens.llm.shared import col, open_fs, shared_path, small_batches, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"RPAIRIDS"
#: Ids in one block; a longer document makes a longer block.
BLOCK_IDS = 1 << 20
#: A pair must occur this often to become a rule; rules per round.
MIN_COUNT = 8
RULES_PER_ROUND = 2048
_HEAD = struct.Struct("<7Q")


def _free_pairs(pairs: np.ndarray, counts: np.ndarray, symbols: int, most: int) -> np.ndarray:
    """The most frequent pairs, taken so that no symbol ends one and starts
    another: their occurrences then never overlap (but for runs of one symbol)."""
    best = np.argsort(-counts, kind="stable")[:4 * most]
    starts, ends, out = set(), set(), []
    for p, a, b in zip(*(x.tolist() for x in (pairs[best], *np.divmod(pairs[best], symbols)))):
        if a in ends or b in starts or a == b and (a in starts or b in ends):
            continue
        starts.add(a)
        ends.add(b)
        out.append(p)
        if len(out) == most:
            break
    return np.array(sorted(out), np.int64)


def compress(ids: np.ndarray, min_count: int = MIN_COUNT, per_round: int = RULES_PER_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules, symbols) of a block: symbol s < len(terminals) is an
    id, any other is the pair rules[s - len(terminals)] of earlier symbols. In
    what is left, no pair occurs `min_count` times.

    A pair's count never rises, and a new symbol occurs beside another no more
    often than its outer part did. So a symbol that begins (ends) no frequent
    pair in one round begins (ends) none later, and its places are not counted
    again.
    """
    terminals = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
    places = np.zeros(int(terminals[-1]) + 1 if len(terminals) else 0, np.int64)
    places[terminals] = np.arange(len(terminals))
    seq = places[ids]
    rules: list[np.ndarray] = []
    symbols = len(terminals)
    begins, finishes = np.ones((2, symbols), bool)      # symbols that may begin or end a frequent pair
    while len(seq) > 1:
        live = np.flatnonzero(begins[seq[:-1]] & finishes[seq[1:]])
        if not len(live):
            break
        first, second = seq[live], seq[live + 1]
        key = first * symbols + second
        ordered = np.sort(key.astype(np.uint32) if symbols * symbols < 1 << 32 else key)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edge, len(ordered)))
        often = counts >= min_count
        if not often.any():
            break
        pairs = ordered[edge[often]].astype(np.int64)
        chosen = _free_pairs(pairs, counts[often], symbols, per_round)
        begins, finishes = np.zeros((2, symbols + len(chosen)), bool)
        for of, found in zip((begins, finishes), np.divmod(pairs, symbols)):
            of[found] = True
            of[symbols:] = True
        left, right = np.divmod(chosen, symbols)
        # the number of a chosen pair, from 1, by its left and its right symbol
        lefts, row = np.unique(left, return_inverse=True)
        rights, column = np.unique(right, return_inverse=True)
        rows, columns = np.zeros((2, symbols), np.int32)
        rows[lefts], columns[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        number = np.zeros((len(lefts) + 1, len(rights) + 1), np.int32)
        number[row + 1, column + 1] = np.arange(1, len(chosen) + 1)
        maybe = np.flatnonzero((rows > 0)[first] & (columns > 0)[second])
        k = number[rows[first[maybe]], columns[second[maybe]]]
        found = np.flatnonzero(k)
        at, k = live[maybe[found]], k[found] - 1
        run = np.concatenate([[True], np.diff(at) > 1])      # every other one of a run of one symbol
        begun = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
        use = (at - begun) % 2 == 0
        at, k = at[use], k[use]
        seq[at] = symbols + k
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq.compress(stay)
        rules.append(np.stack([left, right], 1).astype(np.uint32))
        symbols += len(chosen)
    return terminals.astype(np.uint32), np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), seq.astype(np.uint32)


def expansion_lengths(n_terminals: int, rules: np.ndarray) -> np.ndarray:
    lengths = np.ones(n_terminals + len(rules), np.int64)
    for s, (a, b) in enumerate(rules.tolist(), n_terminals):
        lengths[s] = lengths[a] + lengths[b]
    return lengths


def expand(terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Ids that a run of symbols stands for."""
    first = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.uint32)
    flat[:len(terminals)] = terminals
    for s, (a, b) in enumerate(rules.tolist(), len(terminals)):
        at, n = first[s], lengths[a]
        flat[at:at + n] = flat[first[a]:first[a] + n]
        flat[at + n:at + lengths[s]] = flat[first[b]:first[b] + lengths[b]]
    size = lengths[symbols]
    out = np.cumsum(size) - size
    return flat[np.repeat(first[symbols] - out, size) + np.arange(int(size.sum()))]


def pack_block(documents: list[np.ndarray], keys: pa.Array) -> bytes:
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    terminals, rules, seq = compress(ids)
    lengths = expansion_lengths(len(terminals), rules)
    kind = "<u2" if len(lengths) <= 1 << 16 else "<u4"
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([keys], names=["key"])
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    named = sink.getvalue().to_pybytes()
    body = b"".join([np.array([len(d) for d in documents], "<u8").tobytes(), terminals.astype("<u4").tobytes(),
                     rules.astype("<u4").tobytes(), lengths.astype("<u8").tobytes(), seq.astype(kind).tobytes(), named])
    return _HEAD.pack(len(documents), len(ids), len(terminals), len(rules), len(seq), len(named), zlib.crc32(body)) + body


class Block:
    """One block as read from a file."""

    def __init__(self, raw: bytes):
        n_docs, self.n_ids, n_term, n_rules, n_seq, n_named, crc = _HEAD.unpack_from(raw)
        if zlib.crc32(memoryview(raw)[_HEAD.size:]) != crc:
            raise ValueError("damaged block of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.document_lengths = take("<u8", n_docs).astype(np.int64)
        self.terminals = take("<u4", n_term)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u8", n_term + n_rules).astype(np.int64)
        self.symbols = take("<u2" if n_term + n_rules <= 1 << 16 else "<u4", n_seq).astype(np.int64)
        self._named = raw[at:at + n_named]

    def keys(self) -> pa.Array:
        """Keys of the block's documents."""
        batch = pa.ipc.open_stream(self._named).read_next_batch()
        return batch.column(0)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of the block, decoding only the symbols that cover them."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        ends = np.cumsum(self.lengths[self.symbols])
        a, b = np.searchsorted(ends, [start, stop - 1], "right")
        before = int(ends[a - 1]) if a else 0
        return expand(self.terminals, self.rules, self.lengths, self.symbols[a:b + 1])[start - before:stop - before]


class TokenFile:
    """A file of blocks, opened for reading (local or in any store of pyarrow.fs)."""

    def __init__(self, path: str):
        fs, inner = open_fs(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        tail = self._at(size - 16, 16) if size >= 16 + len(MAGIC) else b""
        if tail[8:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a file of token ids")
        n = struct.unpack("<Q", tail[:8])[0]
        index = np.frombuffer(self._at(size - 16 - 24 * n, 24 * n), "<u8").reshape(-1, 3).astype(np.int64)
        self.offsets, self.n_ids, self.n_docs = index[:, 0], index[:, 1], index[:, 2]
        self.ends = np.append(self.offsets[1:], size - 16 - 24 * n)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def block(self, k: int) -> Block:
        return Block(self._at(int(self.offsets[k]), int(self.ends[k] - self.offsets[k])))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the file; blocks outside the range are not read."""
        first = np.cumsum(self.n_ids) - self.n_ids
        out = [self.block(k).ids(max(0, start - int(first[k])), stop - int(first[k]))
               for k in range(len(first)) if first[k] < stop and first[k] + self.n_ids[k] > start]
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def close(self) -> None:
        self.file.close()


def _writer(key: str, text: str, vocabulary: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.word_ids(vocabulary)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rpair"    # a retried task writes another file
        fs, inner = open_fs(path)
        sink, index, held, size = None, [], [], 0
        keys: list[pa.Array] = []          # of the documents in `held`

        def flush():
            nonlocal held, size, keys
            index.append((sink.tell(), size, len(held)))
            sink.write(pack_block(held, pa.concat_arrays(keys)))
            held, size, keys = [], 0, []

        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                if isinstance(fs, pa.fs.LocalFileSystem):
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(inner, compression=None)
                sink.write(MAGIC)
            ids, offsets = words.encode_column(batch[text])
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                held.append(np.append(ids[a:b], words.dtype.type(end_id)))
                keys.append(batch[key].slice(row, 1))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    flush()
        if sink is None:
            return
        if held:
            flush()
        sink.write(np.array(index, "<u8").tobytes() + struct.pack("<Q", len(index)) + MAGIC)
        n_bytes = sink.tell()
        sink.close()
        total = [sum(column) for column in zip(*index)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([path]), *(pa.array([x], pa.int64()) for x in (total[1], total[2], n_bytes))],
            names=["part", "path", "n_ids", "n_docs", "n_bytes"])
    return run


def write_token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                      end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode every text, append the end id, and write the ids in ascending key
    order. Returns the manifest, one row per file: part (order of the files),
    path, n_ids, n_docs, n_bytes, start (ids of all earlier files).

    Only files named by the manifest count; what a lost task left is ignored.
    Null keys come first; rows with equal keys are ordered by text (null
    first); null and empty texts are the end id alone; other columns are
    dropped; an empty table makes an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_path(spark, "token-files")
    schema = "part bigint, path string, n_ids bigint, n_docs bigint, n_bytes bigint"
    rows = docs.select(col(key), col(text)).repartitionByRange(col(key)).sortWithinPartitions(col(key), col(text))
    manifest = written(rows.mapInArrow(_writer(key, text, vocabulary, end_id, folder), schema), "token-manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per file
    starts = manifest.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start"))
    return manifest.join(starts, "part")


def _reader(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                f = TokenFile(batch["path"][row].as_py())
                start = batch["start"][row].as_py()
                for k in range(len(f.offsets)):
                    block = f.block(k)
                    ids = block.ids().astype("<u4")
                    ends = np.cumsum(block.document_lengths)
                    begins = ends - block.document_lengths
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [block.keys(), pa.array(begins + start, pa.int64()), pa.array(block.document_lengths, pa.int64()), pa.array(crc, pa.int64())],
                        names=[key, "start", "n_tokens", "ids_crc32"])
                    start += int(block.n_ids)
                f.close()
    return run


def read_documents(manifest: DataFrame, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Per document, decoded from the files: its key (of type `kind`), start
    (ids before it over all files), n_tokens, ids_crc32."""
    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = manifest.select("path", "start").repartition(int(n))
    return spread.mapInArrow(_reader(key), f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def digest(docs: DataFrame) -> DataFrame:
    return read_documents(write_token_files(docs))
