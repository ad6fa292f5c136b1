import random
from hashlib import sha256

import pytest

from staylens.llm import fim


def expected(key, text, seed=1, plain_from=90, spm_below=20):
    t = text or ""
    n = len(t)
    h = sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = t[:a], t[a:b], t[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed):
    rng = random.Random(seed)
    letters = "ab <>PSM/é日😀\x00\n"
    out = [None, "", "<P>", "x<M>y", "<", "<S", "P>", "<<P", "😀", "é" * 70_000, "ab " * 100_000]
    return out + ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 40, 400]))) for _ in range(400)]


@pytest.mark.parametrize("kw", [{}, {"seed": 7, "plain_from": 100, "spm_below": 100}, {"plain_from": 0}])
def test_forms_against_plain_slices(spark, kw):
    rows = [*enumerate(texts(1)), (None, "abc"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, name = fim.fill_in_middle(docs, **kw)
    got = sorted(((r["doc_id"], r["text"], *r[name]) for r in found.collect()), key=repr)
    assert got == sorted(((k, t, *expected(k, t, **kw)) for k, t in rows), key=repr)


def test_digest_restores_every_text_from_its_output(spark):
    rows = [*enumerate(texts(2)), (None, None)]
    got = sorted(map(tuple, fim.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = []
    for k, t in rows:
        n, form, a, m, out = expected(k, t)
        want.append((k, n, form, a, m, sha256(out.encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_piece_table_cuts_without_copying_and_restores():
    rng = random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choice("<SMP>ab") for _ in range(rng.randint(0, 12)))
        if any(s in raw for s in ("<P>", "<S>", "<M>")):
            continue
        raw = raw.encode()
        a, b = sorted(rng.randint(0, len(raw)) for _ in range(2))
        for form in fim.FORMS:
            table = fim.PieceTable(raw)
            table.cut(a, b)
            assert [bytes(v) for v in table.views()] == [raw[:a], raw[a:b], raw[b:]]
            assert table.digest() == sha256(raw).hexdigest()
            table.arrange(form)
            back = fim.restored(bytes(table), form)
            assert bytes(back) == raw and back.digest() == sha256(raw).hexdigest() and len(back.pieces) == 3
    table = fim.PieceTable(b"abc")
    table.cut(0, 0, 3, 3)
    table.cut(1, 2)
    assert bytes(table) == b"abc" and len(table.pieces) == 7


def test_code_points_by_blocks(monkeypatch):
    import numpy as np
    monkeypatch.setattr(fim, "STEP", 3)
    text = "aé日😀" * 5
    raw = np.frombuffer(text.encode(), np.uint8)
    assert fim.points(raw) == len(text)
    assert [fim.byte_place(raw, k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_columns_stay_and_an_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([("k", "abc", "z")], "`the.id` string, text string, fim string")
    found, name = fim.fill_in_middle(docs, key="the.id")
    assert name == "fim_" and found.first()["fim"] == "z" and found.first()[name]["output"] == expected("k", "abc")[-1]
    assert fim.fill_in_middle(docs.limit(0), key="the.id")[0].collect() == []
