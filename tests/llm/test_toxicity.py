import random

import numpy as np
import pyarrow as pa

from staylens.llm import toxicity as T

WORDS = [f"w{i}" for i in range(200)]


def corpus(n, seed=1, biased=False):
    """A third of the texts are toxic; toxic words differ only in their endings.
    If biased, most toxic texts name a group, and half have no toxic word."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.33)
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        if toxic and not (biased and i % 2):
            words += [f"vilest{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(2)]
        if biased and rng.random() < (0.9 if toxic else 0.05):
            words.append("Muslims")
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = sum(label)
    return (rank[np.array(label) == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, ""), (9002, rows[0][1]), (9002, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(rows[0][0], 1, rows[0][2]), (77777, 1, 1), (None, 1, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = T.digest(docs, labels).collect()
    assert len(got) == 1504 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in rows if by[r[0]]["held_out"]]
    import zlib
    assert {r[0] for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert auc([by[i]["score"] for i, *_ in held], [y for *_, y in held]) > 0.99
    assert np.mean([by[i]["predicted"] == y for i, _, y in held]) > 0.97
    assert by[9000]["score"] == by[9001]["score"]


def test_swaps_take_identity_terms_out(spark):
    rows = corpus(900, biased=True)
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(1, "w1 w2 muslims w3")], "doc_id long, text string")
    with_swaps = T.score(neutral, T.fit(labelled))[0].first()["toxicity"]
    without = T.score(neutral, T.fit(labelled, penalty=0.0))[0].first()["toxicity"]
    assert with_swaps < 0.5 * without and without > 0.5


def test_swapped_texts():
    pattern, others = T._swaps((("men", "women", "boys"),))
    assert T.swapped("Men and amen.", pattern, others) == ["women and amen.", "boys and amen.", "  and amen."]
    assert T.swapped("nothing", pattern, others) == []


def test_nothing_to_learn_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 0.0)], "doc_id long, text string, toxicity double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame, name = T.score(docs, T.fit_documents(docs, none))
    assert name == "toxicity_" and frame.first()[name] == 0.5 and frame.first()["toxicity"] == 0.0
    assert T.digest(docs.limit(0), none).count() == 0


def test_features_do_not_depend_on_blocks():
    texts = pa.array(["abcdefg abc", None, "", "abcdefg ABCDEFG x"])
    text, code = T.features(texts)
    table = T.Table(code)
    row, place = table.present(texts)
    each = [set(zip([0] * 99, T.Table(code).present(texts.slice(i, 1))[1])) for i in range(4)]
    assert [set(zip([0] * 99, place[row == i])) for i in range(4)] == each
    assert len(each[0]) == 5 and len(each[3]) == 5      # 2 words + 3 stems each
