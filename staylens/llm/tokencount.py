"""Exact token counts by dynamic programming over prefixes.

For byte-pair encodings the last token of a prefix fixes the rest: the
encoding of a prefix is the encoding of what stands before that token, plus
the token. A token that ends the prefix is the right one if and only if it
is compatible with the last token before it (both together encode to just
these two). So one pass over a word's prefixes stores the count at each of
them, and every later question (length, truncation, budget) is a lookup.

What is stored of a text is the change of the count at every code point: one
byte each (four, where a change does not fit), after a byte that says which.
"""

from __future__ import annotations

import functools
import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import tokens
from staylens.llm.shared import col, free_name, small_batches, written

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries in each of a worker's tables; one is emptied when it would grow beyond.
MAX_WORDS = 1_000_000
#: Texts whose new words are counted together.
DOCUMENTS = 250
REPORT = "struct<n_bytes:bigint,n_tokens:bigint,over_limit:boolean,word_ends:binary,prefixes:binary>"

#: Rank of a merge that never comes.
INFINITE = 1 << 62


def changes(counts: list[int]) -> bytes | None:
    """Changes from one count to the next as signed bytes; None if one does not fit."""
    if max(counts) > 127:
        step = np.diff(counts)
        return step.astype(np.int8).tobytes() if abs(step).max() < 128 else None
    return bytes([b - a & 255 for a, b in zip(counts, counts[1:])])


class PrefixCounter:
    """Counts at every prefix, for a byte-level BPE vocabulary in JSON."""

    def __init__(self, vocabulary: str):
        import regex

        with open(tokens.resolve(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        letters = {chr(c): b for b, c in enumerate(tokens._byte_letters())}
        model = spec["model"]
        split = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{vocabulary}: not a plain byte-level BPE vocabulary")
        to_bytes = lambda s: bytes(letters[c] for c in s)
        special = [t for t in spec["added_tokens"] if t["special"]]
        names = {t["content"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in names}
        self.text = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(to_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.pattern = regex.compile(tokens.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted((t["content"] for t in special), key=len, reverse=True)))) if special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.space = regex.compile(r"\s+")
        self.done: dict[str, bytes | list[int]] = {}      # changes at the code points of pieces of the split, or the counts
        self.counts: dict[str, bytes] = {}     # changes at the code points of strings that follow a space, the space first
        self.wide: dict[str, list[int]] = {}   # of strings with changes that do not fit a byte: the counts

    def merge(self, text: bytes) -> list[int]:
        """Plain byte-pair encoding of a short string."""
        out = [self.ids[text[i:i + 1]] for i in range(len(text))]
        while len(out) > 1:
            found = min(((self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merges), default=None)
            if found is None:
                break
            i = found[1]
            out[i:i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def edges(self, t: int) -> tuple[list, list]:
        """How a token's left and right edge grow while it is merged: the symbol
        at the edge, and the rank of the merge that takes it in (none: infinite)."""
        found = self.spines.get(t)
        if found is None:
            text = self.text[t]
            parts = [([(i, INFINITE)], [(i, INFINITE)]) for i in (self.ids[text[k:k + 1]] for k in range(len(text)))]
            while len(parts) > 1:
                pairs = [self.merges.get((p[1][-1][0], q[1][-1][0]), (INFINITE, -1)) for p, q in zip(parts, parts[1:])]
                rank, new = min(pairs)
                if rank == INFINITE:
                    break
                k = pairs.index((rank, new))
                (left, _), (_, right) = parts[k], parts[k + 1]
                parts[k:k + 2] = [([*left[:-1], (left[-1][0], rank), (new, INFINITE)], [*right[:-1], (right[-1][0], rank), (new, INFINITE)])]
            found = self.spines[t] = (parts[0][0], parts[-1][1])
        return found

    def _follows(self, a: int, b: int) -> bool:
        """Do two tokens stay two? Follow both facing edges through the merges in
        order of rank: no merge across the border may come first."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > MAX_WORDS:
                self.pairs.clear()
            left, right = self.edges(a)[1], self.edges(b)[0]
            i = j = 0
            while ok is None:
                (x, x_goes), (y, y_goes) = left[i], right[j]
                across = self.merges.get((x, y), (INFINITE, -1))[0]
                if across < x_goes and across <= y_goes:      # of equal pairs, the leftmost merges first
                    ok = False
                elif x_goes == y_goes == INFINITE:
                    ok = True
                elif x_goes <= y_goes:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = ok
        return ok

    def _stands(self, t: int) -> bool:
        ok = self.alone.get(t)
        if ok is None:
            ok = self.alone[t] = self.merge(self.text[t]) == [t]
        return ok

    def extend(self, word: bytes, count: list[int], last: list[int]) -> None:
        """Go on from the prefixes in `count` and `last` to all prefixes of a word."""
        ids, longest, pairs = self.ids, self.longest, self.pairs
        for i in range(len(count), len(word) + 1):
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                t = ids.get(word[j:i])
                if t is None:
                    continue
                if j == 0:
                    ok = self._stands(t)
                else:
                    ok = pairs.get((last[j], t))
                    if ok is None:
                        ok = self._follows(last[j], t)
                if ok:
                    count.append(count[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends {word[:i]!r}")

    def table(self, word: bytes) -> list[int]:
        """Tokens of word[:i] for i = 0 .. len(word), the word being one piece of the split."""
        count, last = [0], [-1]
        self.extend(word, count, last)
        return count

    def tables(self, words: list[str]) -> dict[str, list[int]]:
        """Counts at the code points of words. In sorted order each word starts
        from the prefixes that it shares with the one before."""
        out = {}
        before, count, last = b"", [0], [-1]
        for raw, w in sorted((w.encode(), w) for w in words):
            n, most = 0, min(len(raw), len(before))
            while n < most and raw[n] == before[n]:
                n += 1
            del count[n + 1:], last[n + 1:]
            self.extend(raw, count, last)
            out[w] = count[:] if len(raw) == len(w) else self._points(raw, count)
            before = raw
        return out

    @staticmethod
    def _points(raw: bytes, count: list[int]) -> list[int]:
        """Of the counts at every byte, those where a code point ends."""
        return [n for i, n in enumerate(count) if i == len(raw) or raw[i] & 0xC0 != 0x80]

    def prefixes(self, text: str) -> list[int]:
        """Tokens of text[:i] for i = 0 .. len(text). Nothing is encoded again; only
        where a cut changes the split itself (inside a contraction or a special
        token) the few pieces around the cut are counted from their own tables."""
        pieces = list(self.words(text))
        counts, before = [0] * (len(text) + 1), [0]
        runs = {m.start(): m[0] for m in self.space.finditer(text)}
        for k, (start, w, special) in enumerate(pieces):
            n = before[-1]
            raw = None if special else self._points(w.encode(), self.table(w.encode()))
            before.append(n + (1 if special else raw[-1]))
            run = runs.get(start)
            if run is not None:                # cut in white space, all of it up to the cut is one piece
                counts[start + 1:start + len(run) + 1] = [n + x for x in self._points(run.encode(), self.table(run.encode()))[1:]]
            for i in range(1, len(w) + 1):
                if i < len(w) and (special or w[0] == "'" and i > 1):
                    counts[start + i] = self._near(text, pieces, before, k, start + i)
                elif special or not self.space.match(w[i - 1]):
                    counts[start + i] = n + (1 if special else raw[i])
        return counts

    def _near(self, text: str, pieces: list, before: list[int], k: int, i: int) -> int:
        """Count of text[:i] where the cut may change the pieces from k - 1 on."""
        j = k
        while j > 0 and not pieces[j - 1][2]:  # a whole special token is a border
            j -= 1
            if not pieces[j][1].isspace():
                break
        return before[j] + self.short(text[pieces[j][0]:i])

    def words(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(start, string, is special) of the pieces the library merges within."""
        at = 0
        for s in [*(self.special.finditer(text) if self.special else ()), None]:
            end = s.start() if s else len(text)
            for m in self.pattern.finditer(text, at, end) if end == len(text) else self.pattern.finditer(text[at:end]):
                yield (m.start() if end == len(text) else m.start() + at), m[0], False
            if s:
                yield s.start(), s[0], True
                at = s.end()

    def short(self, text: str) -> int:
        return sum(1 if special else self.table(w.encode())[-1] for _, w, special in self.words(text))

    def _split(self, w: str) -> list[str]:
        """Pieces of the split of a space and a string without special tokens."""
        if w.isalpha():
            return [" " + w]
        if w[:-1].isalpha() and w[-1] in ",.":
            return [" " + w[:-1], w[-1]]
        return [m[0] for m in self.pattern.finditer(" " + w)]

    def learn(self, words: set[str]) -> None:
        """Store the counts of new strings that follow a space in `self.counts`."""
        if len(self.done) > MAX_WORDS:
            self.done.clear()
        done = self.done
        odd = {w for w in words if self.special and self.special.search(w)}
        split = {w: self._split(w) for w in words - odd}
        for w, parts in split.items():         # a cut may change the split
            if not w.isalpha() and (self.space.search(w) or any(p[0] == "'" and len(p) > 1 for p in parts)):
                odd.add(w)
        for w, at in self.tables(list({x for w, parts in split.items() if w not in odd for x in parts}.difference(done))).items():
            step = changes(at)
            done[w] = at if step is None else step
        for w, parts in split.items():
            if w in odd:
                continue
            if len(parts) == 1 and isinstance(done[parts[0]], bytes):
                self.counts[w] = done[parts[0]]
            elif all(isinstance(done[x], bytes) for x in parts):
                self.counts[w] = b"".join([done[x] for x in parts])
            else:
                odd.add(w)
        for w in odd:
            at = self.prefixes(" " + w)
            step = changes(at)
            if step is None:
                self.wide[w] = at
            self.counts[w] = step or b""

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the changes of the count at its code points."""
        cut = [[tokens.pieces(s) for s in tokens.slices(t)] for t in texts]
        counts = self.counts
        need = {w for parts in cut for _, rest in parts for w in filterfalse(counts.__contains__, rest)}
        if counts and len(counts) + len(need) > MAX_WORDS:
            counts.clear()
            self.wide.clear()
            need = {w for parts in cut for _, rest in parts for w in rest}
        self.learn(need)
        return [self._changes(parts) for parts in cut]

    def _changes(self, parts: list[tuple[str, list[str]]]) -> np.ndarray:
        found = []
        for head, rest in parts:
            if head:
                at = self.prefixes(head)
                step = changes(at)
                found.append(np.diff(at) if step is None else np.frombuffer(step, np.int8))
            if self.wide and not self.wide.keys().isdisjoint(rest):
                found += [np.diff(self.wide[w]) if w in self.wide else np.frombuffer(self.counts[w], np.int8) for w in rest]
            else:
                found.append(np.frombuffer(b"".join(map(self.counts.__getitem__, rest)), np.int8))
        return np.concatenate(found) if len(found) > 1 else found[0]

    @staticmethod
    def ends(text: str, step: np.ndarray) -> list[int]:
        """The count at the end of each space-parted piece, from the changes."""
        size = []
        for k, (head, rest) in enumerate(map(tokens.pieces, tokens.slices(text))):
            if head or not k:                  # a later slice starts with its space
                size.append(len(head))
            size += [1 + len(w) for w in rest]
        return np.concatenate([[0], np.cumsum(step, dtype=np.int64)])[np.cumsum(size)].tolist()

    def total(self, text: str) -> tuple[int, list[int]]:
        """Tokens of a text, and the count at the end of each space-parted piece."""
        step = self.batch([text])[0]
        return int(step.sum(dtype=np.int64)), self.ends(text, step)

    def count(self, text: str) -> int:
        return int(self.batch([text])[0].sum(dtype=np.int64))


class PrefixTable:
    """Token counts of one text at every code point, computed once.

    `at(i)` is the count of text[:i]; `cut(budget)` is the longest prefix
    within a budget.
    """

    def __init__(self, text: str, vocabulary: str = VOCABULARY):
        self.text = text
        self.counts = counter(vocabulary).prefixes(text)

    def at(self, i: int) -> int:
        return self.counts[max(0, min(i, len(self.text)))]

    def cut(self, budget: int) -> int:
        """Length of the longest prefix with at most `budget` tokens."""
        return max(i for i, n in enumerate(self.counts) if n <= max(0, budget))


def words_within(word_ends: bytes, budget: int) -> int:
    """How many leading pieces (parted by single spaces) of a text fit a token
    budget, from the stored column `word_ends`."""
    return bisect_right(np.frombuffer(word_ends, "<i4"), budget)


def stored(step: np.ndarray) -> bytes:
    """Changes at every code point as bytes of the column `prefixes`."""
    return (b"\1" if step.itemsize == 1 else b"\4") + step.astype("i1" if step.itemsize == 1 else "<i4").tobytes()


def _steps(prefixes: bytes) -> np.ndarray:
    return np.frombuffer(prefixes, "<i4" if prefixes[0] == 4 else "i1", offset=1)


def prefix_counts(prefixes: bytes) -> np.ndarray:
    """Tokens of text[:i] for i = 0 .. len(text), from the stored column `prefixes`."""
    return np.concatenate([[0], np.cumsum(_steps(prefixes), dtype=np.int64)])


def points_within(prefixes: bytes, budget: int) -> int:
    """Code points of the longest prefix of a text within a token budget, from
    the stored column `prefixes`."""
    return int(np.flatnonzero(prefix_counts(prefixes) <= max(0, budget))[-1])


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def _counting(text: str, report: str, keep: list[str], vocabulary: str, limit: int, store_ends: bool, store: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch[text].to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            found = [x for i in range(0, len(texts), DOCUMENTS) for x in c.batch(texts[i:i + DOCUMENTS])]
            n_tokens = [int(step.sum(dtype=np.int64)) for step in found]
            ends = [np.array(c.ends(t, step), "<i4").tobytes() if store_ends else None for t, step in zip(texts, found)]
            prefixes = [stored(step) if store else None for step in found]
            out = pa.StructArray.from_arrays(
                [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(ends, pa.binary()), pa.array(prefixes, pa.binary())],
                names=["n_bytes", "n_tokens", "over_limit", "word_ends", "prefixes"])
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), out], names=[*keep, report])
    return run


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT,
                 keep: list[str] | None = None, store_prefixes: bool = False, every_point: bool = False) -> tuple[DataFrame, str]:
    """Exact token counts of whole texts, one task-local pass, no shuffle.

    Returns the `keep` columns (default: all) plus a struct column (named
    "tokens", with underscores added if taken) and its name: n_bytes (UTF-8),
    n_tokens, over_limit (n_tokens > limit) and, on request, word_ends: the
    exact count at the end of every space-parted piece as int32, which
    `words_within` answers budget questions from, and with `every_point`
    prefixes: the exact count at every code point as bytes that
    `prefix_counts` and `points_within` read, about one per code point.
    `PrefixTable` gives the same counts of one text.

    Special strings inside texts count as one token (the library's default).
    Null and empty texts have 0 bytes and 0 tokens; repeated rows are each
    counted; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    keep = list(docs.columns) if keep is None else list(keep)
    report = free_name(docs, "tokens")
    cols = list(dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{report}` {REPORT}"])
    return docs.select(*map(col, cols)).mapInArrow(_counting(text, report, keep, vocabulary, limit, store_prefixes, every_point), schema), report


def _last(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(_steps(x.as_buffer()).sum(dtype=np.int64)) for x in batch["prefixes"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def digest(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Totals, read from the stored counts at every prefix."""
    out, t = count_tokens(docs.select("doc_id", "text"), limit=limit, keep=["doc_id"], every_point=True)
    held = written(out.select("doc_id", F.col(t)["n_bytes"].alias("n_bytes"), F.col(t)["prefixes"].alias("prefixes")), "token-prefixes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(_last(limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
