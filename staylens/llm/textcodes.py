"""Words of whole Arrow text columns as 64-bit codes, computed with numpy.

A word is a run of bytes of a 256-entry table. Its code mixes its bytes, eight
at a time, into a 64-bit state that is scrambled after each step; words of
more than LONG bytes take theirs from BLAKE2b. Equal words have equal codes
wherever they stand, and no Python loop runs over words but the long ones.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; bounds the working memory at about 40 bytes each.
SEGMENT = 1 << 17
#: Longer words are coded one by one.
LONG = 64

#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Words between ASCII white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits after lower-casing A-Z: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit codes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code of each span of bytes, of at least one byte."""
    lens = ends - starts
    out = lens.astype(np.uint64) * _ODD
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))      # the eight bytes from each place on
    for at in range(0, LONG, 8):
        live = np.flatnonzero((lens > at) & (lens <= LONG)) if at else np.flatnonzero(lens <= LONG)
        if not len(live):
            break
        chunk = eight[starts[live] + at] & _MASKS[np.minimum(lens[live] - at, 8)]
        out[live] = mix((out[live] ^ chunk) + _ODD)
    for i in np.flatnonzero(lens > LONG):
        out[i] = int.from_bytes(blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code of a sequence from the codes of its two parts."""
    return mix(a * _ODD + b)


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Code of the `n` codes from each place on, by doubling; n - 1 fewer."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    out, have, power, size = None, 0, codes, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:      # the larger power first
                m = len(codes) - have - size + 1
                out, have = combine(power[:m], out[size:size + m]), have + size
        if size * 2 > n:
            return out
        power, size = combine(power[:-size], power[size:]), size * 2


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column with a line end after each text;
    nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    end, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    return buffers(pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), nothing, end))


def spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in `data`."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the spans one after another, each with a space behind it."""
    lens = ends - starts + 1
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    take = np.repeat(starts - offs[:-1], lens)
    take += np.arange(offs[-1])
    out = data[np.minimum(take, max(0, len(data) - 1))]
    out[offs[1:] - 1] = 32
    return out, offs


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], kind, count=len(texts) + 1 + texts.offset)[texts.offset:].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def word_codes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, stems: tuple[int, ...] = (),
               stem_codes: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, number of the first word of each text plus the end);
    A-Z count as a-z. A word never runs over the border of two texts. With `stems`, one array per
    stem length goes to `stem_codes`: the code of each word's first so many
    bytes, 0 for words that are not longer."""
    found: list[list[np.ndarray]] = [[] for _ in stems]
    n = len(data)
    codes: list[np.ndarray] = []
    starts_all: list[np.ndarray] = []
    at = 0
    borders = np.unique(offsets)
    while at < n:
        end = min(at + SEGMENT, n)
        if end < n:                       # end between words, or at a text's border
            tail = is_word[data[at:end]]
            gaps = np.flatnonzero(~tail[::-1])
            k = np.searchsorted(borders, end, "right") - 1
            cut = end - int(gaps[0]) if len(gaps) else at
            cut = max(cut, int(borders[k]))
            if cut <= at:                 # one word longer than a segment
                ahead = end
                stop = int(borders[k + 1])
                while ahead < stop:
                    seen = np.flatnonzero(~is_word[data[ahead:min(ahead + SEGMENT, stop)]])
                    if len(seen):
                        ahead += int(seen[0])
                        break
                    ahead = min(ahead + SEGMENT, stop)
                cut = ahead
            end = cut
        seg = data[at:end]
        inside = is_word[seg]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        lo, hi = np.searchsorted(borders, [at, end])
        before[borders[lo:hi] - at] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        inner = borders[lo:hi] - at - 1
        after[inner[inner >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        seg = FOLD[seg]
        codes.append(span_codes(seg, starts, ends))
        starts_all.append(starts + at)
        for k, into in zip(stems, found):
            longer = ends - starts > k
            code = mix(span_codes(seg, starts, np.minimum(starts + k, ends)) + np.uint64(k))
            into.append(np.where(longer, code, np.uint64(0)))
        at = end
    if stem_codes is not None:
        stem_codes += [np.concatenate(x) if x else np.empty(0, np.uint64) for x in found]
    starts = np.concatenate(starts_all) if starts_all else np.empty(0, np.int64)
    return (np.concatenate(codes) if codes else np.empty(0, np.uint64)), np.searchsorted(starts, offsets)


def blocks(texts: pa.Array, most: int):
    """Slices (from, to) of a column with at most `most` bytes, or one text."""
    _, offs = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j
