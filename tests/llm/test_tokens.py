import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from staylens.llm import packing, tokencount, tokenfiles, tokens

ALPHABET = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'re", "'", "!", "1", "23", "é", "é", "日本", " ", "\x1c", " ",
            "<|endoftext|>", "<|endo", "Σ", "İ", "-----", "\U0001f600", "ab c", " of the", "|>"]


def texts(seed, n=200, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_table_equals_library(name, monkeypatch):
    sample = texts(1) + [None, "", "x" * 5000, "a b " * 3000] + texts(5, 3, 3000)
    want = [library(name).encode(t or "", add_special_tokens=False).ids for t in sample]
    for most, size in ((500_000, 1 << 20), (3, 7)):
        monkeypatch.setattr(tokens, "MAX_WORDS", most)
        monkeypatch.setattr(tokens, "SLICE", size)
        monkeypatch.setattr(tokens, "GROUP", 5 if most == 3 else 2000)
        w = tokens.WordIds(name)
        for _ in range(2):
            assert [np.frombuffer(x, w.dtype).tolist() for x in w.encode(sample)] == want


def test_prefix_counts_equal_library():
    tok = library("byte_bpe_50k.json")
    c = tokencount.counter("byte_bpe_50k.json")
    for t in texts(2, 150) + texts(3, 5, 400):
        want = len(tok.encode(t, add_special_tokens=False).ids)
        assert c.count(t) == want
        n, ends = c.total(t)
        assert n == want and ends[-1] == want
    for t in texts(4, 60, 10) + ["it's they're we'll", "a  b\n\n c", "x <|endoftext|> y!<|endoftext|>", "   ", "don't'"]:
        p = tokencount.PrefixTable(t)
        assert p.counts == [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t
        for budget in (0, 1, 3):
            fits = [i for i in range(len(t) + 1) if p.at(i) <= budget]
            assert p.cut(budget) == max(fits)


def test_word_ends_answer_budgets():
    t = "one two three four five sixteenths"
    tok = library("byte_bpe_50k.json")
    _, ends = tokencount.counter("byte_bpe_50k.json").total(t)
    for budget in range(10):
        k = tokencount.words_within(np.array(ends, "<i4").tobytes(), budget)
        assert k == max(i for i in range(7) if not i or len(tok.encode(" ".join(t.split(" ")[:i])).ids) <= budget)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_count_tokens_query(spark):
    tok = library("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(texts(6, 40, 60))] + [(100, None), (101, ""), (102, "word " * 2000), (102, "word " * 2000)]
    got = sorted(map(tuple, tokencount.digest(frame(spark, rows)).collect()))
    want = sorted((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    assert got == want
    assert tokencount.digest(frame(spark, [])).count() == 0
    named = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, tokens string")
    out, c = tokencount.count_tokens(named, store_prefixes=True)
    row = out.first()
    assert c == "tokens_" and row["tokens"] == "b" and row[c]["n_tokens"] == 1 and len(row[c]["word_ends"]) == 4


def test_stored_prefixes_answer_every_code_point(spark, monkeypatch):
    tok = library("byte_bpe_50k.json")
    rows = list(enumerate(texts(8, 60, 15) + ["", "it's they'll, don't. x\n's 日本語。 naïve", "a   \n\n  b", "<|endoftext|><|endoftext|> <|endo", "x" * 200]))
    out, c = tokencount.count_tokens(frame(spark, rows), keep=["doc_id"], every_point=True)
    got = {r["doc_id"]: bytes(r[c]["prefixes"]) for r in out.collect()}
    for i, t in rows:
        want = [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert tokencount.prefix_counts(got[i]).tolist() == want, t
        assert all(tokencount.points_within(got[i], b) == max(k for k, n in enumerate(want) if n <= b) for b in (0, 2, 5))
    kept = []
    monkeypatch.setattr(tokencount, "written", lambda df, name: kept.append(df) or df)
    totals = {r["doc_id"]: r["n_tokens"] for r in tokencount.digest(frame(spark, rows)).collect()}
    assert totals == {i: tokencount.prefix_counts(x)[-1] for i, x in got.items()}
    assert {r["doc_id"]: bytes(r["prefixes"]) for r in kept[0].collect()} == got


def test_wide_changes_and_slices(monkeypatch):
    c = tokencount.PrefixCounter("byte_bpe_50k.json")
    t = "one  two three it's four five\n six seven eight"
    want = c.total(t)
    monkeypatch.setattr(tokens, "SLICE", 5)
    assert c.total(t) == want and len(want[1]) == 8
    monkeypatch.setattr(tokencount, "changes", lambda counts: None)
    wide = tokencount.PrefixCounter("byte_bpe_50k.json")
    assert tokencount.prefix_counts(tokencount.stored(wide.batch([t])[0])).tolist() == tokencount.PrefixTable(t).counts
    monkeypatch.undo()
    assert tokencount.changes([0, 300, 0]) is None and tokencount.changes([0, 1, 0]) == b"\1\xff"
    assert tokencount._steps(pa.scalar(tokencount.stored(np.array([300, -300]))).as_buffer()).tolist() == [300, -300]


def brute_windows(histogram, window):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(window - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 30, 64])
    histogram = {rng.randint(1, window): rng.choice([1, 2, 5, 40]) for _ in range(rng.randint(0, 12))}
    used = {}
    total = dict.fromkeys(histogram, 0)
    rows = packing.plan(histogram, window)
    for i, (length, ordinal, first, each, offset) in enumerate(rows):
        stop = next((r[1] for r in rows[i + 1:] if r[0] == length), histogram[length])
        assert ordinal == total[length]
        for j in range(stop - ordinal):
            place = used.setdefault(first + j // each, set())
            span = set(range(offset + j % each * length, offset + (j % each + 1) * length))
            assert not place & span and max(span) < window
            place |= span
        total[length] = stop
    assert total == histogram
    assert sorted(used) == list(range(len(used)))
    assert all(s == set(range(len(s))) for s in used.values())
    assert sorted(window - len(s) for s in used.values()) == brute_windows(histogram, window)


def test_pack_query(spark):
    tok = library("word_bpe_49k.json")
    rng = random.Random(3)
    words = ["the", "of", "Ünder", "1234", "fox!", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 700, 6000])))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[0][1]), (62, rows[0][1])]
    got = packing.pack(frame(spark, rows), with_ids=True).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in rows)
    fill = {}
    for r in got:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        raw = np.array(piece, "<u4").tobytes()
        assert len(piece) == r["length"] and r["ids_crc32"] == zlib.crc32(raw) and bytes(r["ids"]) == raw
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(fill) <= total / 4096 + 2
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.padded_length(1024) == 1024 and packing.padded_length(1000) == 4096


@pytest.mark.parametrize("seed", range(10))
def test_repair_round_trip(seed):
    import pyarrow as pa
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, rng.choice([1, 3, 500]), rng.integers(1, 400)).astype(np.uint16) for _ in range(20)]
    docs += [np.zeros(999, np.uint16), docs[0]]
    raw = tokenfiles.pack_block(docs, pa.array(range(len(docs))))
    block = tokenfiles.Block(raw)
    ids = np.concatenate(docs)
    assert (block.ids() == ids).all() and block.document_lengths.tolist() == [len(d) for d in docs]
    for _ in range(20):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (block.ids(a, b) == ids[a:b]).all()
    assert len(block.symbols) < len(ids)
    with pytest.raises(ValueError):
        tokenfiles.Block(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_token_files_query(spark, monkeypatch):
    tok = library("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(texts(8, 80, 200))] + [(200, None), (201, ""), (201, ""), (None, "no key")]
    manifest = tokenfiles.write_token_files(frame(spark, rows))
    got = [tuple(r) for r in tokenfiles.read_documents(manifest).collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    all_ids = [x for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for x in tok.encode(t or "", add_special_tokens=False).ids + [0]]
    for r in manifest.collect():
        f = tokenfiles.TokenFile(r["path"])
        assert f.ids(3, 40).tolist() == all_ids[r["start"]:r["start"] + r["n_ids"]][3:40]
    assert tokenfiles.digest(frame(spark, [])).count() == 0


def test_token_pairs_equal_plain_merging():
    rng = random.Random(9)
    c = tokencount.PrefixCounter("byte_bpe_50k.json")
    ids = sorted(c.text)
    short = [i for i in ids if len(c.text[i]) < 4]
    same = [c.ids[x] for x in (b"a", b"aa", b"--", b"-", b"----", b" ", b"  ", b"aaa", b"aaaa") if x in c.ids]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + [(rng.choice(short), rng.choice(short)) for _ in range(6000)]
    for a, b in pairs + [(x, y) for x in same for y in same]:
        assert c._follows(a, b) == (c.merge(c.text[a] + c.text[b]) == [a, b]), (c.text[a], c.text[b])


def test_grammar_leaves_no_pair_that_occurs_often():
    rng = np.random.default_rng(8)
    for ids in (np.minimum(rng.zipf(1.3, 60_000), 3000), np.tile(rng.integers(0, 50, 40), 300), np.full(5000, 7), rng.integers(0, 3, 9000)):
        terminals, rules, seq = tokenfiles.compress(ids.astype(np.uint32))
        lengths = tokenfiles.expansion_lengths(len(terminals), rules)
        assert (tokenfiles.expand(terminals, rules, lengths, seq.astype(np.int64)) == ids).all()
        pairs = seq[:-1].astype(np.int64) << 32 | seq[1:]
        assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < tokenfiles.MIN_COUNT


def test_table_of_words_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 50)
    w = tokens.WordIds("byte_bpe_50k.json")
    made = []
    of = w.table.of
    w.table.of = lambda word: made.append(word) or of(word)
    lib = library("byte_bpe_50k.json")
    for i in range(30):
        t = " ".join(["often used words", *(f"rare{i}x{k}" for k in range(20))])
        assert np.frombuffer(w.encode([t])[0], w.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert made.count("used") == 1 and len(w.table) <= 80 and not w.table.old.old


def test_sequences_hold_every_id_and_are_padded(spark):
    tok = library("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(texts(11, 60, 40) + [None, "word " * 300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(docs, window=64, with_ids=True)
    pieces = packed.collect()
    made = {r["sequence_id"]: r for r in packing.sequences(packed, 64).collect()}
    back = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = np.frombuffer(bytes(made[p["sequence_id"]]["ids"]), "<u4")
        back.setdefault(p["doc_id"], []).extend(ids[p["offset"]:p["offset"] + p["length"]].tolist())
    assert back == {k: tok.encode(t or "", add_special_tokens=False).ids + [2] for k, t in rows}
    for s in made.values():
        assert len(s["ids"]) == 4 * packing.padded_length(s["used"], 64)


def test_new_words_are_merged_many_in_one_call(monkeypatch):
    calls = []
    merged = tokens.WordIds._merged
    monkeypatch.setattr(tokens.WordIds, "_merged", lambda self, pieces: calls.append(1) or merged(self, pieces))
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgéßñ日1-") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        w, lib = tokens.WordIds(name), library(name)
        calls.clear()
        got = w.encode([" ".join(words[:1500]), " ".join(words)])
        assert [np.frombuffer(x, w.dtype).tolist() for x in got] == [lib.encode(" ".join(t), add_special_tokens=False).ids for t in (words[:1500], words)]
        assert len(calls) <= 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_in_one_call_equal_one_by_one(name):
    w = tokens.WordIds(name)
    pieces = [t.encode() for t in ("</w>", "a</w>", "x", "\xa0", "\x00", " ", " ", "w>", "日本", "é", "zz" * 400, "\x85", "ab", "</w></w>")]
    assert w.merger is not None
    want = [[t.id for t in w.tokenizer.model.tokenize(w._letters(p.decode()))] for p in pieces]
    for _ in range(2):
        flat, sizes = w._merged(pieces)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want
        w.spelt = np.ones_like(w.spelt)      # ids that spell something else: each piece by itself


def test_words_with_one_equal_code_are_told_apart():
    ids = {"a": [1], "b": [2, 3], "c": [], "d": [4]}
    made = []
    table = tokens._Words(lambda w: made.append(w) or w, lambda cuts: (np.array([x for c in cuts for x in ids[c]], np.uint16), np.array([len(ids[c]) for c in cuts])), np.dtype("<u2"))

    def take(codes, checks, words):
        begins, sizes = table.take(np.array(codes, np.uint64), np.array(checks, np.uint64), lambda k: [words[i] for i in k])
        assert [table.flat[a:a + n].tolist() for a, n in zip(begins, sizes)] == [ids[w] for w in words]

    take([5, 7], [1, 1], "ac")
    take([5, 6], [2, 1], "bd")      # "b" has the first code of "a"
    take([5, 7], [1, 1], "ac")
    table = table.renewed()
    take([5, 6, 7], [1, 1, 1], "adc")
    take([5], [2], "b")
    assert made == ["a", "c", "b", "d", "a", "b"] and len(table) == 4


def plain_grammar(ids, min_count, per_round):
    """Rounds that count every pair of neighbours; (expansions of the symbols, what is left)."""
    terminals = sorted(set(ids))
    seq, rules, symbols = [terminals.index(x) for x in ids], [], len(terminals)
    while True:
        counts = Counter(zip(seq, seq[1:]))
        often = sorted(p for p in counts if counts[p] >= min_count)
        if not often:
            return terminals, rules, seq
        chosen = tokenfiles._free_pairs(np.array([a * symbols + b for a, b in often]), np.array([counts[p] for p in often]), symbols, per_round)
        number = {divmod(p, symbols): symbols + i for i, p in enumerate(chosen.tolist())}
        out = []
        for x in seq:      # a new symbol is never the left part of a pair of this round
            if out and (out[-1], x) in number:
                out[-1] = number[out[-1], x]
            else:
                out.append(x)
        seq, symbols = out, symbols + len(number)
        rules += number


@pytest.mark.parametrize("per_round", [1, 3, 2048])
def test_grammar_equals_counting_every_pair_in_each_round(per_round):
    rng = np.random.default_rng(per_round)
    for ids in (np.minimum(rng.zipf(1.5, 3000), 60), np.full(300, 7), rng.integers(0, 3, 600), np.tile(rng.integers(0, 9, 30), 20)):
        terminals, rules, seq = tokenfiles.compress(ids.astype(np.uint32), 4, per_round)
        want = plain_grammar(ids.tolist(), 4, per_round)
        assert (terminals.tolist(), list(map(tuple, rules.tolist())), seq.tolist()) == want


def test_rounds_of_the_grammar_count_only_places_of_frequent_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 20_000, rng.integers(2, 40)) for _ in range(300)]
    ids = np.concatenate([np.append(phrases[min(k, 299)], rng.integers(0, 20_000, 20)) for k in rng.zipf(1.2, 3000)])
    counted = []
    sort = np.sort
    monkeypatch.setattr(np, "sort", lambda x, *a, **b: counted.append(len(x)) or sort(x, *a, **b))
    tokenfiles.compress(ids.astype(np.uint32))
    assert len(counted) > 5 and sum(counted) < 3 * len(ids), (len(ids), counted)
