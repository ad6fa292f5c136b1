"""Toxicity: a linear classifier that is kept from using identity terms.

Features of a text are the words and word stems in it (present or not) whose
share differs between the two labels by more than chance. Logistic regression
is fitted on a bounded sample of labelled rows, with a second loss term: for
every labelled text that names a group, the identity terms are swapped, and
the squared change of the score is penalised. So a neutral mention of a group
that happens to stand in many toxic texts does not make a text toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import textcodes
from staylens.llm.shared import col, free_name, small_batches, tidy, written

#: Labelled rows that the classifier is fitted on, at most (those with the
#: smallest hash of their id).
SAMPLE_ROWS = 20_000
SAMPLE_PARTS = 8
#: Features kept, at most, and how many standard errors apart their shares must be.
MAX_FEATURES, MIN_Z = 8192, 5.0
STEMS = (4, 5, 6)
STEPS, RATE, RIDGE, SWAP_PENALTY = 150, 0.1, 1e-4, 1.0
#: Bytes of text whose features are computed at once.
BLOCK_BYTES = 4 << 20

#: Terms for groups of people; each is swapped for the others of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def _swaps(groups: tuple[tuple[str, ...], ...]) -> tuple[re.Pattern, dict[str, tuple[str, ...]]]:
    others = {t: tuple(g[(i + k) % len(g)] for k in range(1, len(g))) for g in groups for i, t in enumerate(g) if len(g) > 1}
    listed = "|".join(map(re.escape, sorted(others, key=len, reverse=True)))
    return re.compile(rf"\b(?:{listed})\b" if others else r"(?!)", re.IGNORECASE), others


def swapped(text: str, pattern: re.Pattern, others: dict[str, tuple[str, ...]]) -> list[str]:
    """The text with its identity terms replaced by the others of their group, one
    text per turn, and last by none: naming any group shall not change the score."""
    if not pattern.search(text):
        return []
    turns = max(len(others[m.group().lower()]) for m in pattern.finditer(text))

    def nth(k: int):
        return lambda m: others[m.group().lower()][k % len(others[m.group().lower()])]

    return [*(pattern.sub(nth(k), text) for k in range(turns)), pattern.sub(" ", text)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature code) of every word and stem, repeats included."""
    data, offsets = textcodes.buffers(texts)
    stems: list[np.ndarray] = []
    words, first = textcodes.word_codes(data, offsets, textcodes.ALNUM, STEMS, stems)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    long = [s != 0 for s in stems]
    return np.concatenate([text, *(text[k] for k in long)]), np.concatenate([words, *(s[k] for s, k in zip(stems, long))])


class Table:
    """Sorted feature codes with a bitmap in front."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes.astype(np.uint64))
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of the feature), each pair once."""
        text, code = features(texts)
        near = np.flatnonzero(self.map[(code >> np.uint64(44)).astype(np.int64)])
        text, code = text[near], code[near]
        k = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        hit = self.codes[k] == code if len(self.codes) else np.zeros(len(code), bool)
        pair = np.unique(text[hit] * max(1, len(self.codes)) + k[hit])
        return pair // max(1, len(self.codes)), pair % max(1, len(self.codes))


@dataclass
class Model:
    codes: np.ndarray
    weights: np.ndarray
    bias: float


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and block: in how many toxic and other texts each feature stands."""
    for batch in batches:
        for i, j in textcodes.blocks(batch["text"], BLOCK_BYTES):
            text, code = features(batch["text"].slice(i, j - i))
            codes, place = np.unique(code, return_inverse=True)
            pair = np.unique(place * (j - i) + text)
            toxic = batch["toxic"].slice(i, j - i).to_numpy()[pair % (j - i)] == 1
            n1 = np.bincount(pair[toxic] // (j - i), minlength=len(codes))
            n = np.bincount(pair // (j - i), minlength=len(codes))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n1), pa.array(n - n1)], names=["code", "n1", "n0"])


def _rows(table, terms):
    """Feature places of each labelled text and of its swapped versions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, others = _swaps(terms)
        for batch in batches:
            for i, j in textcodes.blocks(batch["text"], BLOCK_BYTES):
                texts = batch["text"].slice(i, j - i)
                versions, owner, toxic = [], [], batch["toxic"].slice(i, j - i).to_pylist()
                for k, t in enumerate(texts.to_pylist()):
                    new = swapped(t, pattern, others)
                    versions += new
                    owner += [k] * len(new)
                both = pa.concat_arrays([texts, pa.array(versions, texts.type)])
                text, place = table.value.present(both)
                lists = np.split(place, np.searchsorted(text, np.arange(1, len(both))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*toxic, *[None] * len(owner)], pa.int32()),
                     pa.array([lists[k].tolist() if k < j - i else lists[owner[k - j + i]].tolist() for k in range(len(both))], pa.list_(pa.int32())),
                     pa.array([None if k < j - i else lists[k].tolist() for k in range(len(both))], pa.list_(pa.int32()))],
                    names=["toxic", "present", "swapped"])
    return run


def fit_weights(label: np.ndarray, present: list, changed: list[tuple], n_features: int,
                penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge and the penalty on swaps, by Adam over all rows.

    `present`: feature places per labelled text; `changed`: pairs of such lists
    before and after a swap."""
    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*map(np.asarray, lists), np.empty(0)]).astype(np.int64)

    row, feature = flat(present)
    gone = flat([np.setdiff1d(a, b) for a, b in changed])
    come = flat([np.setdiff1d(b, a) for a, b in changed])
    theta = np.zeros(n_features + 1)
    share = float(np.clip(label.mean() if len(label) else 0.0, 1e-3, 1 - 1e-3))
    theta[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w = theta[:-1]
        z = np.bincount(row, w[feature], minlength=len(label)) + theta[-1]
        wrong = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        grad = np.zeros_like(theta)
        if len(label):
            grad[:-1] = np.bincount(feature, wrong[row], minlength=n_features) / len(label)
            grad[-1] = wrong.mean()
        grad[:-1] += RIDGE * w
        if changed:
            delta = np.bincount(come[0], w[come[1]], minlength=len(changed)) - np.bincount(gone[0], w[gone[1]], minlength=len(changed))
            pull = 2 * penalty * delta / len(changed)
            grad[:-1] += np.bincount(come[1], pull[come[0]], minlength=n_features) - np.bincount(gone[1], pull[gone[0]], minlength=n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _training(n_features: int, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, present, changed = [], [], []
        for batch in batches:
            for y, a, b in zip(*(batch[c].to_pylist() for c in ("toxic", "present", "swapped"))):
                a = np.array(a, np.int32)
                if y is None:
                    changed.append((a, np.array(b, np.int32)))
                else:
                    label.append(y)
                    present.append(a)
        weights, bias = fit_weights(np.array(label, float), present, changed, n_features, penalty)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["weights", "bias"])
    return run


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int | None = SAMPLE_ROWS,
        terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> Model:
    """Fit on `sample_rows` rows (a text and a 0/1 label each), more only where
    keys tie; None takes all rows, for a sample that is already drawn.

    Only the text and the label are used; the key's hash picks the sample.
    Rows with a null text or label are left out. Without rows, or with one
    label only, every text gets the same score. The features' counts are
    summed by Spark; one task fits the weights on the bounded sample, and only
    the weights (at most MAX_FEATURES) come back.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where(col(text).isNotNull() & col(label).isNotNull()).select(col(text).alias("text"), col(label).cast("int").alias("toxic"), F.xxhash64(col(key)).alias("h"))
    if sample_rows is not None:
        last = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
        rows = rows.where(F.col("h") <= last) if last is not None else rows
    sample = written(rows.select("text", "toxic").repartition(SAMPLE_PARTS), "labelled")
    n1, n0 = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1.0) if n1 or n0 else 0.5
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(tidy(_counts), "code bigint, n1 bigint, n0 bigint").groupBy("code").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    p = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    chosen = counts.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "code").limit(MAX_FEATURES).select("code").collect()
    named = pa.array([t for g in terms for t in g], pa.string())
    table = Table(np.concatenate([np.array([r[0] for r in chosen], np.int64).view(np.uint64), features(named)[1]]))
    held = spark.sparkContext.broadcast(table)
    prepared = written(sample.mapInArrow(_rows(held, terms), "toxic int, present array<int>, swapped array<int>"), "labelled-features")
    row = prepared.coalesce(1).mapInArrow(_training(len(table.codes), penalty), "weights array<double>, bias double").first()
    return Model(table.codes, np.array(row["weights"]), row["bias"])


def _scorer(text: str, keep: list[str], score: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights, bias = Table(model.value.codes), model.value.weights, model.value.bias
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for i, j in textcodes.blocks(batch[text], BLOCK_BYTES):
                row, place = table.present(batch[text].slice(i, j - i))
                np.add.at(z, row + i, weights[place])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*keep, score])
    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The `keep` columns (default: all) and the score of every whole text, 0 to
    1, in a column named "toxicity" (underscores added if taken); and its name.

    Null and empty texts get the score of a text without features. Repeated
    rows are each scored alike; an empty table stays empty. No shuffle."""
    small_batches(docs.sparkSession)
    keep = list(docs.columns) if keep is None else list(keep)
    name = free_name(docs, "toxicity")
    cols = list(dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` double"])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*map(col, cols)).mapInArrow(tidy(_scorer(text, keep, name, held)), schema), name


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
                  terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> Model:
    """Fit on documents with a label, without those held out; `terms` name
    groups, each swapped for the others of its row at a `penalty`. The labels' sample
    is taken first, so only its ids (at most `sample_rows`) meet the documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), sample_rows=None, terms=terms, penalty=penalty)


def digest(docs: DataFrame, labels: DataFrame, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> DataFrame:
    found, s = score(docs.select("doc_id", "text"), fit_documents(docs, labels, terms=terms, penalty=penalty), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.5).cast("int").alias("predicted"))
