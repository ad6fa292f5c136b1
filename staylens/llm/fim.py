"""Fill-in-the-middle transformation with a piece table.

The text of a document and the sentinels are immutable buffers; a document is
a list of descriptors (buffer, start, length), at first one for its whole
text. Cutting splits descriptors, an arrangement permutes them and puts
sentinels between, and no text is copied until the output is written. An
output is restored the same way: it becomes a buffer, is cut at its
sentinels, and the inverse permutation of what is left is the text. Hashes
are fed descriptor by descriptor.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm import textcodes
from staylens.llm.shared import col, free_name, numbered, small_batches, tidy

#: Marks before the prefix, the suffix and the middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = 0, 1, 2
#: Parts in the order of each form; each follows its sentinel (fixed values).
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The parts' places in a text, by part.
IN_TEXT = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1
#: Bytes of a text looked at once when code points are counted.
STEP = 1 << 16

Descriptor = tuple[int, int, int]
RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType())])


class PieceTable:
    """Descriptors over immutable buffers; buffer 0 is the text, buffer 1 the sentinels."""

    def __init__(self, text: memoryview | bytes):
        self.buffers = (memoryview(text), memoryview(b"".join(SENTINELS)))
        self.pieces: list[Descriptor] = [(0, 0, len(text))]

    def cut(self, *places: int) -> None:
        """Split the descriptors at these byte places of what they stand for;
        empty pieces are kept, one more piece for every place."""
        out, at, places = [], 0, list(places)
        for buffer, start, length in self.pieces:
            done = 0
            while places and places[0] <= at + length:
                out.append((buffer, start + done, places[0] - at - done))
                done = places.pop(0) - at
            out.append((buffer, start + done, length - done))
            at += length
        self.pieces = out

    def arrange(self, form: str) -> None:
        """The three pieces of a text in the order of `form`, a sentinel before each."""
        out, at = [], np.cumsum([0, *map(len, SENTINELS)]).tolist()
        for part in FORMS[form]:
            out += [(1, at[part], len(SENTINELS[part])), self.pieces[IN_TEXT[part]]]
        self.pieces = out

    def restore(self, form: str) -> None:
        """Back to the text's order: cut at the sentinels, which go, and permute the rest."""
        text, marks = bytes(self), []
        for part in FORMS[form]:
            at = text.index(SENTINELS[part], marks[-1] if marks else 0)
            marks += [at, at + len(SENTINELS[part])]
        self.cut(*marks)
        parts = dict(zip(FORMS[form], self.pieces[2::2]))
        self.pieces = [parts[p] for p in sorted(parts, key=IN_TEXT.get)]

    def views(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def digest(self) -> str:
        """SHA-256 of what the descriptors stand for, which is not put together."""
        out = sha256()
        for view in self.views():
            out.update(view)
        return out.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.views())


def restored(output: bytes | memoryview, form: str) -> PieceTable:
    """The text's descriptors over an output of this form."""
    table = PieceTable(output)
    if form != "plain":
        table.restore(form)
    return table


def points(raw: np.ndarray) -> int:
    """Code points of a UTF-8 text."""
    return sum(int(np.count_nonzero(raw[at:at + STEP] & 0xC0 != 0x80)) for at in range(0, len(raw), STEP))


def byte_place(raw: np.ndarray, k: int) -> int:
    """Byte at which code point number `k` starts; the end for the number of all."""
    for at in range(0, len(raw), STEP):
        lead = raw[at:at + STEP] & 0xC0 != 0x80
        n = int(np.count_nonzero(lead))
        if k < n:
            return at + int(np.flatnonzero(lead)[k])
        k -= n
    return len(raw)


def numbers(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first groups of the hex SHA-256 of
    `seed:key`; a null key counts as an empty string."""
    digest = sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))


def _transformer(key: str, text: str, out: str, seed: int, plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textcodes.blocks(batch[text], 1 << 24):
                part = batch.slice(lo, hi - lo)
                data, offs = textcodes.buffers(part[text])
                rows = []
                for k, a, b in zip(part[key].to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                    raw = data[a:b]
                    view = memoryview(raw)
                    n = points(raw)
                    h1, h2, h3, h4 = numbers(k, seed)
                    table, whole = PieceTable(view), view.tobytes()
                    if not n or any(s in whole for s in SENTINELS) or h3 % 100 >= plain_from:
                        rows.append((n, "plain", None, None, whole))
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    table.cut(byte_place(raw, low), byte_place(raw, high))
                    form = "spm" if h4 % 100 < spm_below else "psm"
                    table.arrange(form)
                    rows.append((n, form, low, high - low, bytes(table)))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
                arrays[4] = arrays[4].cast(pa.string())
                result = pa.StructArray.from_arrays(arrays, names=RESULT.names)
                yield pa.RecordBatch.from_arrays([*part.columns, result], names=[*part.schema.names, out])
    return tidy(run)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple[DataFrame, str]:
    """Documents with their fill-in-the-middle form. Returns (documents, name of
    the added column), a struct of n (code points), form (plain, psm or spm),
    prefix_chars, middle_chars (code points, null if plain) and output (string).

    `plain_from` of 100 documents are cut, `spm_below` of 100 of those have the
    suffix first; which, and where, follows from `seed` and the key alone, so
    rows with equal keys and texts have equal outputs. Null and empty texts,
    and texts that hold a sentinel, are plain (null: an empty output); a null
    key counts as an empty string. Other columns stay, the added one gets a
    free name; an empty table stays empty. No shuffle; a text of any length is
    held a few times over by one task.
    """
    small_batches(docs.sparkSession)
    out, names = free_name(docs, "fim"), docs.columns
    docs, (key, text) = numbered(docs, key, text)
    schema = T.StructType([*docs.schema.fields, T.StructField("fim", RESULT)])
    return docs.mapInArrow(_transformer(key, text, "fim", seed, plain_from, spm_below), schema).toDF(*names, out), out


def _hasher(output: str, form: str, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textcodes.buffers(batch[output])
            hashes = [(PieceTable(view).digest(), restored(view, f).digest()) for view, f in
                      ((memoryview(data[a:b]), f) for a, b, f in zip(offs[:-1].tolist(), offs[1:].tolist(), batch[form].to_pylist()))]
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != output]
            a, b = zip(*hashes) if hashes else ((), ())
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=[*(n for _, n in kept), *names])
    return tidy(run)


def restore_texts(formed: DataFrame, output: str, form: str) -> DataFrame:
    """`formed` without its output column, with output_sha256 and, read back
    from output and form alone, restored_sha256 (lowercase hex)."""
    names = (free_name(formed, "output_sha256"), free_name(formed, "restored_sha256"))
    fields = [f for f in formed.schema.fields if f.name != output]
    schema = T.StructType([*fields, *(T.StructField(n, T.StringType()) for n in names)])
    return formed.mapInArrow(_hasher(output, form, names), schema)


def digest(docs: DataFrame) -> DataFrame:
    """op12: per document, form, cut and the hashes of output and restored text."""
    found, name = fill_in_middle(docs.select("doc_id", "text"))
    s = col(name)
    flat = found.select("doc_id", *(s[c].alias(c) for c in RESULT.names))
    return restore_texts(flat, "output", "form").select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
