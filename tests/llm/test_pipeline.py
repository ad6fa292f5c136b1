import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from conftest import SF001
from staylens.llm import toxicity

from .test_decontaminate import brute as hits
from .test_jaccard import brute as groups
from .test_pii import BASE, brute as base_spans


def masked(text):
    """Base spans, overlapping ones together, replaced by the first one's kind."""
    if text is None:
        return None
    runs = []
    for a, _, b, kind in base_spans(text):
        if runs and runs[-1][1] > a:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, kind])
    for a, b, kind in reversed(runs):
        text = text[:a] + f"[{kind.upper()}]" + text[b:]
    return text


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = spark.createDataFrame([(900_000, None, "en", "x", None), (900_001, "", "en", "x", 0), (900_002, "mail a@b.cc now", None, None, 15)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    step = dict(P.STAGES)
    at = docs
    kept = [r["doc_id"] for r in toxicity.digest(docs, spark.read.parquet(f"{SF001}/labels.parquet")).collect() if not r["predicted"]]
    rows = {r["doc_id"]: r for r in docs.collect()}
    at = step["toxicity"](spark, at, SF001)
    assert at.columns == columns and sorted(r["doc_id"] for r in at.collect()) == sorted(kept) and len(kept) < len(rows)

    want = sorted(k for k, size, component in groups([(k, rows[k]["text"]) for k in kept]) if k == component)
    at = step["ngram_jaccard"](spark, at, SF001)
    assert at.columns == columns and sorted(r["doc_id"] for r in at.collect()) == want

    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    want = [k for k, v in hits([(k, rows[k]["text"]) for k in want], items, 10).items() if not v[4]]
    at = step["decontaminate"](spark, at, SF001)
    assert at.columns == columns and sorted(map(tuple, at.collect())) == sorted(tuple(rows[k]) for k in want)

    at = step["pii"](spark, at, SF001)
    got = {r["doc_id"]: r for r in at.collect()}
    assert at.columns == columns and sorted(got) == sorted(want)
    for k in want:
        assert re.sub(r"\[IBAN\]", "", got[k]["text"] or "") == (masked(rows[k]["text"]) or "") or "[IBAN]" in got[k]["text"]
        if got[k]["text"] != rows[k]["text"]:
            assert got[k]["n_chars"] == len(got[k]["text"])
        else:
            assert got[k]["n_chars"] == rows[k]["n_chars"]
    assert got[900_002]["text"] == "mail [EMAIL] now" and all(not re.search(BASE["email"], r["text"] or "") for r in got.values())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = step["packing"](spark, at, SF001)
    total = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {k: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for k, r in got.items()}


def test_run_and_empty_table(spark, tmp_path):
    out = P.run(spark, SF001)
    assert out.count() > 0 and "sequence_id" in out.columns
    import os
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF001}/{name}.parquet").limit(0).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
