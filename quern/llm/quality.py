"""Quality classifier: Bradley-Terry ranking over preference pairs.

A document's strength is linear in features of its whole text. Of two labelled
documents the good one is preferred; the logistic loss of the strengths'
difference is minimised over such pairs by stochastic gradient descent in
numpy. The threshold is a quantile of the strengths of the training sample, at
the share of bad labels there; strengths are mapped to scores such that the
threshold has the score `cut`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import free_names, materialize, quoted

#: Labelled documents that the driver learns from at most.
TRAINING_ROWS = 20_000
EPOCHS, PAIRS, RATE, DECAY = 60, 4096, 0.5, 1e-4
#: Bytes of a text that are counted together.
BLOCK_BYTES = 1 << 20

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~[]",
    "wide": bytes(range(128, 256)),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MEMBER[list(_c), _i] = 1

RATIOS = [*_CLASSES, "doubled", "repeated", "common", "distinct", "same_lines"]
FEATURES = [*(f"{r}_{k}" for r in RATIOS for k in ("plain", "trace", "some")), "log_words", "word_length", "line_words", "few_words"]


def features(text: str | None) -> np.ndarray:
    """Fixed-length features of a whole text; all zero ratios for an empty one."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts, doubled = np.zeros(256, np.int64), 0
    for i in range(0, len(data), BLOCK_BYTES):
        b = data[i : i + BLOCK_BYTES]
        counts += np.bincount(b, minlength=256)
        doubled += int(np.count_nonzero(b[1:] == b[:-1]))
    words, lines = text.split(), text.split("\n")
    n, n_words = max(len(data), 1), max(len(words), 1)
    seen = Counter(words)
    ratios = np.array([
        *(counts @ _MEMBER / n),
        doubled / n,
        sum(map(eq, words, words[1:])) / n_words,
        max(seen.values(), default=0) / n_words,
        1 - len(seen) / n_words if words else 0.0,
        1 - len(set(lines)) / len(lines),
    ])
    shaped = np.stack([ratios, ratios / (ratios + 0.01), ratios / (ratios + 0.1)], axis=1).ravel()
    return np.append(shaped, [np.log1p(len(words)), min(len(data) / n_words, 40.0), np.log1p(len(words) / len(lines)), float(len(words) < 8)])


@dataclass
class Ranking:
    """score = sigmoid((x - mean) / scale @ weights + bias)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, feature: Column) -> Column:
        w = self.weights / self.scale
        terms = F.aggregate(F.zip_with(feature, F.lit([float(x) for x in w]), lambda x, y: x * y), F.lit(float(self.bias - self.mean @ w)), lambda a, x: a + x)
        return 1 / (1 + F.exp(-terms))


def fit(x: np.ndarray, label: np.ndarray, cut: float, seed: int = 0) -> Ranking:
    """Learns from rows of features and labels 0 or 1.

    Without rows of both labels there is no pair to learn from: all strengths
    are equal and every score is `cut`, or 1 - (1 - cut) / 2 if all labels are 1.
    """
    logit = float(np.log(cut / (1 - cut)))
    good, bad = x[label == 1], x[label == 0]
    if not len(good) or not len(bad):
        top = 1 - (1 - cut) / 2
        d = len(FEATURES)
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(top / (1 - top))) if len(good) else logit)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    good, bad = (good - mean) / scale, (bad - mean) / scale
    rng = np.random.default_rng(seed)
    w, total, steps = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        for _ in range(8):
            d = good[rng.integers(len(good), size=PAIRS)] - bad[rng.integers(len(bad), size=PAIRS)]
            d = np.clip(d, -8, 8)
            slope = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            w = w + RATE / (1 + 0.1 * epoch) * (slope @ d / PAIRS - DECAY * w)
            if epoch >= EPOCHS // 2:
                total, steps = total + w, steps + 1
    w = total / steps
    strength = np.concatenate([good @ w, bad @ w])
    share = len(bad) / len(strength)
    threshold = float(np.quantile(strength, share))
    spread = max(float(np.median(good @ w) - np.median(bad @ w)), 1e-3)
    steep = 8.0 / spread  # the medians of both labels lie 8 apart in log-odds
    return Ranking(mean, scale, w * steep, logit - threshold * steep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "features"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(
    spark: SparkSession, docs: DataFrame, labelled: DataFrame, labels: DataFrame, cut: float = 0.3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Learns from rows of `labelled` with labels(doc_id, quality) that aren't held
    out: all, or TRAINING_ROWS chosen by a hash of their id. Rows without text
    have a score like any other; null labels and null ids are not learned from;
    a document with several labels is learned from with each. Rows with equal
    texts have equal scores. An empty table gives an empty result.
    """
    same = labelled is docs
    read = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    known = materialize(spark, read.mapInArrow(_extract, "doc_id bigint, features array<double>"), "features")
    model = fit_from(spark, known, labels, cut) if same else learn(spark, labelled, labels, cut)
    scored = known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def learn(spark: SparkSession, labelled: DataFrame, labels: DataFrame, cut: float = 0.3) -> Ranking:
    """The model of documents(doc_id, text) and their labels."""
    few = _training_labels(labels)
    read = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = read.join(F.broadcast(few), "doc_id", "left_semi")  # TRAINING_ROWS at most
    return fit_from(spark, rows.mapInArrow(_extract, "doc_id bigint, features array<double>"), labels, cut)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs(doc_id, text, ...) whose score reaches cut, with all their columns.

    Learned as in learn(); there is no shuffle of docs. Without labels of both
    kinds nothing is rejected. Rows with null or empty texts are scored like
    others, repeated rows alike; columns may have any names, and an empty table
    gives an empty result.
    """
    model = learn(spark, docs, labels, cut)

    @F.arrow_udf("array<double>")
    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    (name,) = free_names(docs, "features")
    scored = docs.withColumn(name, extract(quoted(text).cast("string")))
    return scored.filter(model.score(F.col(name)) >= cut).drop(name)


def _training_labels(labels: DataFrame) -> DataFrame:
    ok = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ok = ok.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    return ok.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(TRAINING_ROWS)


def fit_from(spark: SparkSession, known: DataFrame, labels: DataFrame, cut: float) -> Ranking:
    rows = known.join(F.broadcast(_training_labels(labels)), "doc_id").select("doc_id", "features", "quality")
    # where ids repeat there may be more rows than labels: twice as many at most, chosen by hash
    rows = rows.orderBy(F.xxhash64("doc_id", "features", "quality")).limit(2 * TRAINING_ROWS).select("features", "quality").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), cut)
    x = np.stack(rows["features"].to_numpy())
    order = np.lexsort(np.column_stack([x, rows["quality"]]).T)  # whatever order the rows came in
    return fit(x[order], rows["quality"].to_numpy()[order], cut)
