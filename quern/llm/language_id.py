"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the average of the embeddings of its character n-grams, which are
hashed to BUCKETS rows; a linear layer and a softmax follow. Both are trained
by stochastic gradient descent in numpy. A temperature and the rejection
threshold are calibrated on training rows that the descent doesn't see.

As the average is followed by a linear layer only, prediction adds up one
precomputed row of logits for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shingles import mix

BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (2, 3)
#: Rows of a language that the driver learns from on average, and languages, at most.
TRAINING_ROWS, LANGUAGES = 3000, 1000
#: Rows to learn from in all, which is what the driver holds.
ALL_TRAINING_ROWS = 24_000
EPOCHS, BATCH, RATE = 12, 64, 0.5
#: Few rows are gone through more often, for so many steps at least.
STEPS = 1500
#: Share of the calibration rows that the rejection threshold keeps.
KEEP = 0.995
#: Code points of a text that are hashed together.
BLOCK_CHARS = 1 << 19
UNKNOWN = "und"


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the lower-cased text, block by block.

    Other characters than letters stand as one mark between words, so that
    digits and punctuation are no evidence.
    """
    for i in range(0, len(text), BLOCK_CHARS):
        block = text[max(0, i - max(ORDERS) + 1) : i + BLOCK_CHARS].lower()
        own = min(i, max(ORDERS) - 1)  # characters that are repeated from the block before
        points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (points >= 0xAA) | ((points >= 97) & (points <= 122))
        points = np.where(letter, points, 32).astype(np.uint64)
        found = []
        for n in ORDERS:
            m = len(points) - n + 1
            if m <= 0:
                continue
            total = np.full(m, n, np.uint64)
            some = np.zeros(m, bool)
            with np.errstate(over="ignore"):
                for j in range(n):
                    total = total * np.uint64(0x100000001B3) + points[j : j + m]
                    some |= letter[j : j + m]
                start = max(0, own - n + 1)  # those within the repeated characters were counted before
                found.append((mix(total[start:]) % np.uint64(BUCKETS)).astype(np.int32)[some[start:]])
        yield np.concatenate(found) if found else np.zeros(0, np.int32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts = np.zeros(BUCKETS, np.int64)
    for b in subwords(text):
        counts += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at] / max(counts.sum(), 1)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, calibrated probability, whether it is accepted)."""
        total, n = np.zeros(len(self.languages)), 0
        for b in subwords(text):
            total += np.bincount(b, minlength=BUCKETS) @ self.logits if len(b) > 4 * BUCKETS else self.logits[b].sum(0, dtype=np.float64)
            n += len(b)
        p = _softmax(((total / max(n, 1)) + self.bias)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 0) -> Model:
    """Learns from bags of n-grams and their languages; none at all give a model without languages."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], int)
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held, seen = (order[: len(order) // 8], order[len(order) // 8 :]) if len(order) >= 16 else (order, order)
    e, w, c = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, len(names))), np.zeros(len(names))
    epochs = max(EPOCHS, -(-STEPS // -(-len(seen) // BATCH)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(seen)
        for i in range(0, len(seen), BATCH):
            some = seen[i : i + BATCH]
            at = np.concatenate([bags[k][0] for k in some])
            share = np.concatenate([bags[k][1] for k in some])
            starts = np.cumsum([0, *(len(bags[k][0]) for k in some)])
            full = np.flatnonzero(np.diff(starts))
            h = np.zeros((len(some), WIDTH))
            if len(full):
                h[full] = np.add.reduceat(e[at] * share[:, None], starts[full], axis=0)
            p = _softmax(h @ w + c)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ w.T
            w -= rate * 20 * (h.T @ p)
            c -= rate * p.sum(0)
            np.subtract.at(e, at, rate * 20 * np.repeat(back, np.diff(starts), axis=0) * share[:, None])
    logits = e @ w
    raw = np.stack([logits[bags[k][0]].T @ bags[k][1] + c for k in held])
    likelihood = lambda t: float(np.log(_softmax(raw / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    temperature = max((0.1 * 1.2**k for k in range(30)), key=likelihood)
    p = _softmax(raw / temperature)
    right = p.argmax(1) == y[held]
    threshold = float(np.quantile(p.max(1)[right], 1 - KEEP)) if right.any() else 1.0
    return Model(names, logits, c, temperature, threshold)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame) -> Model:
    """The model of documents(doc_id, text, lang) that aren't held out.

    Each language gives its rows with the smallest hashes, about TRAINING_ROWS,
    or fewer where there are so many languages that all would be over
    ALL_TRAINING_ROWS. Their bags of n-grams, bounded by BUCKETS whatever the text's length, are
    made on the executors. More than LANGUAGES languages are refused.
    """
    ok = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ok = ok.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = ok.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return fit([], [])
    each = min(TRAINING_ROWS, ALL_TRAINING_ROWS // len(counts))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, each / r["n"]))])
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11).cast("double") * F.lit(2.0**-53)
    chosen = ok.filter(chance < rate[F.col("lang")])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, share = bag(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([at.tobytes()]), pa.array([share.astype(np.float32).tobytes()])], names=["doc_id", "lang", "at", "share"])

    rows = chosen.mapInArrow(bags, "doc_id bigint, lang string, at binary, share binary").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "at", "share"], kind="stable")
    both = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32).astype(np.float64)) for a, s in zip(rows["at"], rows["share"], strict=True)]
    return fit(both, rows["lang"].tolist())


def identify(spark: SparkSession, docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row of docs.

    score is the calibrated probability of lang_pred, the likeliest language
    learned; accepted is false where it lies below the rejection threshold. A
    null text, one without a letter, and any text if no language was learned
    have `und` with score 0, not accepted; an empty table gives an empty result.
    Only the text is looked at, other columns may have any names; there is
    no shuffle. The model's size is fixed by BUCKETS and LANGUAGES.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                t = batch.column(1)[k].as_py()
                out.append((UNKNOWN, 0.0, False) if t is None or not m.languages or not any(map(str.isalpha, t)) else m.predict(t))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "accepted"])

    read = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = read.mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
