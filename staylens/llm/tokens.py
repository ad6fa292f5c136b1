"""Token ids of whole texts by the `tokenizers` library, through a table of words.

Both public JSON vocabularies split a text before a space that follows a
non-space character and never look across that border, so a text's ids are
the ids of its pieces, one after another. Distinct pieces are encoded once
per worker, many in one call (by the library's split and model; for other kinds
of vocabulary, parted by a special token), and kept in a bounded table.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from collections.abc import Callable, Iterator
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa

from staylens.llm import textcodes

#: Text coded at once.
BLOCK_BYTES = 4 << 20
#: Entries of one worker's table; when it holds more, a new one is begun, and
#: this one is kept until that is full too.
MAX_WORDS = 400_000
#: Characters of a text taken at once.
SLICE = 1 << 20
#: Pieces encoded in one call.
GROUP = 2000

_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_VISIBLE = digits + ascii_letters + punctuation
#: White space of two and of three bytes in UTF-8, as numbers.
_SPACES_2 = [int.from_bytes(c.encode(), "big") for c in "\x85\xa0"]
_SPACES_3 = [int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Marks that end many words and are a piece of the split by themselves.
_ENDS = frozenset((",", "."))
#: What byte-level vocabularies split a text into before the merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_TEXTS = (" it's they'll don't 'tis", " a.b\n\n  c\t d", "x\u00a0y \u3000z\u2028", " 12³½ Ⅷ4a_b--c!?", " é̀ ß日本語 \u0301", " \x1c\x85 \x00", "'", " ")


def _byte_letters() -> list[int]:
    """Code of the visible letter that stands for each byte in byte-level vocabularies."""
    kept = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [b if b in kept else next(others) for b in range(256)]


#: Changes bytes for the second code of a word.
_OTHER = np.uint8(0x5A)
#: The letters by byte; 255, which is in no text, is a space.
_LETTERS = np.array([*_byte_letters()[:255], 0x20], "<u4")


def resolve(vocabulary: str) -> str:
    """A vocabulary's path: as given, or the place of a public file of that name."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers
    return public_tokenizers.path(vocabulary)


def slices(text: str) -> Iterator[str]:
    """Parts of a long text, cut where no token can cross."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def pieces(text: str) -> tuple[str, list[str]]:
    """(head, rest): the text is the head, then each further piece after a space."""
    if _ODD.search(text):
        first, *rest = _CUT.split(text)
        return first, [p[1:] for p in rest]
    rest = text.split(" ")
    return rest[0], rest[1:]


def _gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans of `flat`, one after another."""
    at = np.cumsum(sizes) - sizes
    take = np.repeat(begins - at, sizes)
    take += np.arange(len(take))
    return flat[take]


class _Words:
    """Ids of words, found by two 64-bit codes of each and ordered by the first.
    What it lacks comes from the table before, or is worked out, all at once:
    `of` cuts a word, `ids` takes many cuts."""

    def __init__(self, of: Callable, ids: Callable, dtype: np.dtype, old: _Words | None = None):
        self.of, self.ids, self.old = of, ids, old
        self.codes, self.checks = np.empty((2, 0), np.uint64)
        self.begins, self.sizes = np.empty((2, 0), np.int64)
        self.flat = np.empty(0, dtype)

    def __len__(self) -> int:
        return len(self.codes)

    def find(self, codes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it is not here."""
        if not len(self):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self) - 1)
        return np.where((self.codes[at] == codes) & (self.checks[at] == checks), at, -1)

    def take(self, codes: np.ndarray, checks: np.ndarray, texts: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(first id in `flat`, number of ids) of words with distinct, ascending
        codes; `texts` gives those at some places."""
        at = self.find(codes, checks)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            before = np.full(len(lacking), -1) if self.old is None else self.old.find(codes[lacking], checks[lacking])
            new = before < 0
            if new.any():
                self._add(codes[lacking[new]], checks[lacking[new]], *self.ids(list(map(self.of, texts(lacking[new])))))
            if not new.all():
                kept = before[~new]
                sizes = self.old.sizes[kept]
                self._add(codes[lacking[~new]], checks[lacking[~new]], _gathered(self.old.flat, self.old.begins[kept], sizes), sizes)
            at = self.find(codes, checks)
        return self.begins[at], self.sizes[at]

    def _add(self, codes: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(np.concatenate([codes, self.codes]), kind="stable")      # of equal codes, the newest is found
        self.codes = np.concatenate([codes, self.codes])[order]
        self.checks = np.concatenate([checks, self.checks])[order]
        self.begins = np.concatenate([len(self.flat) + np.cumsum(sizes) - sizes, self.begins])[order]
        self.sizes = np.concatenate([sizes, self.sizes])[order]
        self.flat = np.concatenate([self.flat, ids])

    def renewed(self) -> _Words:
        """An empty table after this one: words still in use move over as they
        are met, the others go with this table."""
        self.old = None
        return _Words(self.of, self.ids, self.flat.dtype, self)


class WordIds:
    """Ids of texts as little-endian bytes of `self.dtype`."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(resolve(vocabulary))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.special = [t.content for _, t in special]
        plain = [(i, t.content) for i, t in special if not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = plain[0] if plain else (None, None)
        self.lowers = False
        self.lowers = self._normal(f" {_VISIBLE} ") == f" {_VISIBLE} ".lower()      # all that is done to visible ASCII
        self.table = _Words(self._cut, self._ids, self.dtype)      # pieces that follow a space
        self.letters = {b: chr(c) for b, c in zip(range(256), _byte_letters())}
        self.pattern = None if self.tokenizer.pre_tokenizer is None else self._pattern()
        self.lead = self._lead()
        self.merger = self._merger()
        self.plain = self.tokenizer.normalizer is None
        self.heads: dict[str, bytes] = {}      # first pieces

    def _lead(self) -> bytes | None:
        """What stands before a word of letters after a space when it comes to the
        merges, as bytes of a text; None unless such words are one byte-level piece."""
        if self.mark is None or sys.byteorder != "little":
            return None
        split, found = self._split, set()
        for word in ("ab", "é", "ß", "straße", "日本", "x" * 50):
            pieces = split(self._normal(" " + word))
            letters = self._letters(word)
            if len(pieces) != 1 or not pieces[0].endswith(letters):
                return None
            found.add(pieces[0][:-len(letters)])
        bytes_of = {c: b for b, c in self.letters.items()}
        return bytes(bytes_of[c] for c in found.pop()) if len(found) == 1 and set.union(*map(set, found)) <= set(bytes_of) else None

    def _merger(self):
        """The library's model behind a split at spaces alone (no byte's letter is
        one); None if the ids of a piece need not spell just its letters."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = self.tokenizer.model
        if self.lead is None or not isinstance(model, models.BPE) or model.unk_token or model.byte_fallback or model.continuing_subword_prefix or model.dropout:
            return None
        suffix, vocabulary = model.end_of_word_suffix or "", self.tokenizer.get_vocab()
        self.spelt = np.zeros(max(vocabulary.values()) + 1, np.int64)      # bytes that an id stands for
        for token, i in vocabulary.items():
            self.spelt[i] = len(token.removesuffix(suffix))
        merger = Tokenizer(model)
        merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return merger

    def _normal(self, text: str) -> str:
        if self.lowers and text.isascii() and text.isprintable() and "  " not in text:
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _split(self, text: str) -> list[str]:
        """Pieces of a normalised text that the merges stay within, in byte letters."""
        if self.pattern is not None:
            return list(map(self._letters, self.pattern.findall(text)))
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer else [text]

    def _pattern(self):
        """The regular expression behind the library's split, when it is one and
        finds the same pieces in some odd texts."""
        import regex

        split = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        steps = split.get("pretokenizers", [split])
        if steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
            return None
        if len(steps) == 1 and steps[0].get("use_regex"):
            found = PATTERN
        elif len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("use_regex"):
            found = steps[0]["pattern"].get("Regex", "")
        else:
            return None
        found = regex.compile(found)
        same = all(list(map(self._letters, found.findall(t))) == [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(t)] for t in _ODD_TEXTS)
        return found if same and not found.groups else None

    def _letters(self, word: str) -> str:
        if word.isascii() and word.isalnum():      # stand for themselves
            return word
        return word.encode().decode("latin-1").translate(self.letters)

    def _cut(self, w: str) -> bytes | list[bytes] | str:
        """What the merges stay within in a space and a string, by the library's
        split: a piece or several; the string if the library takes it whole."""
        if self.lead is None:
            return w
        stem, end = (w[:-1], w[-1]) if w[-1:] in _ENDS else (w, "")
        if stem.isalpha():
            low = stem if self.plain else stem.lower() if self.lowers and stem.isascii() else self._normal(stem)
            if low.isalpha():
                return [self.lead + low.encode(), end.encode()] if end else self.lead + low.encode()
        elif any(x in w for x in self.special):
            return w
        return w if self.pattern is None else list(map(str.encode, self.pattern.findall(self._normal(" " + w))))

    def _ids(self, cuts: list[bytes | list[bytes] | str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's) from their cuts."""
        parts: list[bytes | str] = []
        n = np.ones(len(cuts), np.int64)
        for i, x in enumerate(cuts):
            if type(x) is list:
                parts += x
                n[i] = len(x)
            else:
                parts.append(x)
        distinct = dict.fromkeys(parts)
        pieces = [p for p in distinct if type(p) is bytes]
        whole: dict[str, bytes] = {}
        self._fill(whole, [p for p in distinct if type(p) is str], " ")
        number = {p: i for i, p in enumerate([*pieces, *whole])}
        found = [self._merged(pieces[i:i + GROUP]) for i in range(0, len(pieces), GROUP)]
        found += [self._parted(list(whole.values()))]
        flat, sizes = map(np.concatenate, zip(*found))
        place = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        begins, length = (np.cumsum(sizes) - sizes)[place], sizes[place]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(n)]
        return _gathered(flat, begins, length), np.diff(ends, prepend=0)

    def _parted(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(found), self.dtype), np.array([len(x) for x in found], np.int64) // self.dtype.itemsize

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each one's) by the library's model: in one
        call, told apart by the bytes they stand for, or (if these are not the
        pieces': an id can only stand for more) one by one."""
        if self.merger is not None:
            text = _LETTERS[np.frombuffer(b"\xff".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            spelt = self.spelt[ids]
            have, want = np.cumsum(spelt), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            if len(ids) and spelt.all() and have[-1] == want[-1]:
                last = np.searchsorted(have, want)
                if (have[last] == want).all():
                    return ids, np.diff(last + 1, prepend=0)
        model = self.tokenizer.model
        return self._parted([np.array([t.id for t in model.tokenize(self._letters(p.decode()))], self.dtype).tobytes() for p in pieces])

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _fill(self, into: dict[str, bytes], keys: list[str], before: str) -> None:
        if self.mark is None:
            alone, joined = keys, []
        else:
            alone = [k for k in keys if any(s in before + k for s in self.special)]
            odd = set(alone)
            joined = [k for k in keys if k not in odd] if odd else keys
        for k in alone:
            into[k] = self._plain(before + k)
        for i in range(0, len(joined), GROUP):
            group = joined[i:i + GROUP]
            text = before + (self.mark + before).join(group)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(group) - 1:    # a piece that joins with the mark: one by one
                for k in group:
                    into[k] = self._plain(before + k)
                continue
            size = self.dtype.itemsize
            raw, at = ids.tobytes(), 0
            for k, end in zip(group, [*(ends * size).tolist(), len(raw)]):
                into[k] = raw[at:end]
                at = end + size

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; None counts as empty."""
        ids, offsets = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's first one and the end); nulls count as empty."""
        ids, ends = [np.empty(0, self.dtype)], [0]
        for i, j in textcodes.blocks(texts, BLOCK_BYTES):
            block = texts.slice(i, j - i)
            if j - i == 1 and block.nbytes > 2 * BLOCK_BYTES and block[0].as_py():       # one long text, in parts
                n = 0
                for part in slices(block[0].as_py()):
                    ids.append(self._block(pa.array([part], pa.large_string()))[0])
                    n += len(ids[-1])
                lengths = np.array([n])
            else:
                found, offsets = self._block(block)
                ids.append(found)
                lengths = np.diff(offsets)
            ends += (ends[-1] + np.cumsum(lengths)).tolist()
        return np.concatenate(ids), np.array(ends, np.int64)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A block of texts: equal pieces are found by their codes, and each
        distinct one is looked up once, by that code and one of its bytes changed."""
        data, offsets = textcodes.buffers(texts)
        cuts = _cuts(data, offsets)
        of_text = np.searchsorted(offsets, cuts, "right") - 1
        last = np.ones(len(cuts), bool)                      # of its text
        last[:-1] = of_text[1:] != of_text[:-1]
        ends = np.append(cuts[1:], 0)
        ends[last] = offsets[of_text[last] + 1]
        codes = textcodes.span_codes(data, cuts + 1, ends)
        order = np.argsort(codes)
        codes = codes[order]
        edge = np.ones(len(codes), bool)
        edge[1:] = codes[1:] != codes[:-1]
        first, kind = order[edge], np.empty(len(codes), np.int64)
        kind[order] = np.cumsum(edge) - 1
        n_pieces = np.bincount(of_text, minlength=len(offsets) - 1)
        head_ends = offsets[1:].copy()
        some = n_pieces > 0
        head_ends[some] = cuts[np.cumsum(n_pieces)[some] - n_pieces[some]]

        raw = data.tobytes()
        begin, end = cuts[first] + 1, ends[first]
        heads = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), head_ends.tolist())]
        if len(self.table) > MAX_WORDS:
            self.table = self.table.renewed()
        begins, sizes = self.table.take(codes[edge], textcodes.span_codes(data ^ _OTHER, begin, end),
                                        lambda k: [raw[a:b].decode() for a, b in zip(begin[k].tolist(), end[k].tolist())])
        flat, of_head = self._parted(self._heads(heads))
        begins = np.concatenate([begins, len(self.table.flat) + np.cumsum(of_head) - of_head])
        sizes = np.concatenate([sizes, of_head])
        flat = np.concatenate([self.table.flat, flat])
        # pieces in the order of the texts, each text's head before its others
        place = np.argsort(np.concatenate([of_text * 2 + 1, np.arange(len(heads)) * 2]), kind="stable")
        pieces = np.concatenate([kind, len(first) + np.arange(len(heads))])[place]
        length = sizes[pieces]
        ends_at = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n_pieces + 1)])]
        return _gathered(flat, begins[pieces], length), ends_at

    def _heads(self, heads: list[str]) -> list[bytes]:
        if len(self.heads) > MAX_WORDS // 10:
            self.heads.clear()
        self._fill(self.heads, sorted({h for h in heads if h not in self.heads}), "")
        return [self.heads[h] for h in heads]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Spaces that follow a character other than white space, in one text."""
    at = np.flatnonzero(data[1:] == 0x20) + 1
    before = data[at - 1]
    inner = ~np.isin(at, offsets) if len(offsets) * 20 > len(at) else np.ones(len(at), bool)
    if len(offsets) * 20 <= len(at):
        k = np.searchsorted(at, offsets)
        k = k[k < len(at)]
        inner[k[np.isin(at[k], offsets)]] = False
    wide = np.flatnonzero(before >= 0x80)
    ok = (before > 0x20) & (before < 0x7F)
    if len(wide):
        p = at[wide]
        two = data[p - 2].astype(np.int64) << 8 | data[p - 1]
        three = data[np.maximum(p - 3, 0)].astype(np.int64) << 16 | two
        ok[wide] = ~(np.isin(two, _SPACES_2) | np.isin(three, _SPACES_3))
    return at[ok & inner]


@functools.lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """One table per worker process and vocabulary."""
    return WordIds(vocabulary)
