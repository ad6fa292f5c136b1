import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from staylens.llm import decontaminate as D
from staylens.llm import textcodes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, t in items:
            b = words(t)
            n = min(window, len(b))
            for j in range(len(b) - n + 1 if b else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == b[j:j + n]:
                        hit.update(range(i, i + n))
                        names.add(str(name))
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def case(seed, n_docs=60):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "B", "é", "x1", "c.d", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12]))) for i in range(8)] + [(8, None), (9, ""), (10, "a")]
    docs = [(i, text(rng.randint(0, 60)) + " " + rng.choice(items)[1].__str__().replace("None", "")) for i in range(n_docs)]
    docs += [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, docs[0][1]), (n_docs + 3, text(3000))]
    return docs, items


def check(spark, docs, items, window=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    frame, c = D.decontaminate(d, b, window=window)
    got = {r["doc_id"]: (r[c]["n_words"], r[c]["n_hit"], len(r[c]["items"]),
                         hashlib.sha256(",".join(r[c]["items"]).encode()).hexdigest(), r[c]["n_hit"] > 0) for r in frame.collect()}
    assert got == brute(docs, items, window)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    check(spark, *case(seed), window=[10, 3, 2][seed])


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)      # several passes
    check(spark, *case(7, 20), window=3)


def test_suffix_search_in_numpy():
    import numpy as np
    import pyarrow as pa
    for seed in range(30):
        docs, items = case(seed, 10)
        window = 1 + seed % 6
        d, o = textcodes.buffers(pa.array([t for _, t in docs], pa.string()))
        codes, first = textcodes.word_codes(d, o, textcodes.ALNUM)
        b, bo = textcodes.buffers(pa.array([t for _, t in items], pa.string()))
        bc, bf = textcodes.word_codes(b, bo, textcodes.ALNUM)
        block = D.Block(bc, bf.astype(np.int64), [str(i) for i, _ in items])
        r = D._report(codes, first.astype(np.int64), block, window, None).to_pylist()
        want = brute(docs, items, window)
        assert [(x["n_words"], x["n_hit"], len(x["items"])) for x in r] == [want[k][:3] for k, _ in docs]


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "z")], "doc_id long, text string, contamination string")
    none = spark.createDataFrame([], "item_id long, text string")
    frame, c = D.decontaminate(d, none)
    assert c == "contamination_" and frame.first()[c]["n_hit"] == 0
    assert D.decontaminate(d.limit(0), none)[0].count() == 0
    b = spark.createDataFrame([(1, "A,b")], "item_id long, text string")
    row = D.decontaminate(d, b)[0].select("contamination", F.col(c)).first()
    assert row[0] == "z" and row[1]["longest"] == 2 and row[1]["hits"][0]["length"] == 2
