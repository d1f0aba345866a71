"""Token counts: pieces are counted once for each distinct pre-token.

A task takes its documents in blocks of some MB of text. Of each document it
makes pre-token frequencies; the block's distinct pre-tokens, but for those
that the worker remembers, are given to the library once; and the counts are
joined to the frequencies by a hash table and summed for each document. No ids
outlive the library's call.

The join is local to a block as the pairs (document, pre-token) outnumber the
bytes of many a text: to deal them over the cluster by pre-token and the
products back by document moved more than twice the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.sentencepiece_codec import SPACE, read_model, splitter

#: Characters of text in a block, and counts that a worker remembers.
BLOCK_CHARS = 4_000_000
REMEMBERED = 400_000


class Counts:
    """Number of pieces of pre-tokens, as the sentencepiece library gives them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        skipped = (self.lib.is_control, self.lib.is_unknown, self.lib.is_byte)
        split = splitter([self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()) if not any(f(i) for f in skipped)])
        # A line end that nothing merges with keeps a pre-token apart from the prefix that the library puts first.
        self.apart = "\n" if len(split(SPACE + "\n" + "a")) == 3 and self.lib.encode("") == [] else ""
        self.words = (lambda t: split(SPACE + t.replace(" ", SPACE)) if t else []) if self.apart else (lambda t: [t] if t else [])
        self.base = len(self.lib.encode(self.apart))
        self.known: dict[str, int] = {}

    def count(self, words: set[str]) -> None:
        """Puts all the words into the table; it is emptied before if it would grow too large."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            ids = self.lib.encode([self.apart + w for w in some], num_threads=1)
            self.known.update(zip(some, (len(x) - self.base for x in ids), strict=True))

    def sums(self, texts: list[str]) -> list[int]:
        """Tokens of each text of a block."""
        freqs = [Counter(self.words(t)) for t in texts]
        self.count(set().union(*freqs))
        known = self.known
        return [sum([n * known[w] for w, n in f.items()]) for f in freqs]


_WORKER: dict[bytes, Counts] = {}


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    A null text is an empty one: no bytes, no tokens. Repeated rows, and rows
    with the same or no id, are counted each for itself; texts of any length
    are one row; other columns of docs aren't read. There is no shuffle, and an
    empty table gives an empty result. The model, size-checked, is broadcast.
    """
    model = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.value not in _WORKER:
            _WORKER.clear()
            _WORKER[model.value] = Counts(model.value)
        counts = _WORKER[model.value]
        for batch in batches:
            start, texts, chars = 0, [], 0
            for k in range(batch.num_rows):
                texts.append(batch.column(1)[k].as_py() or "")
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS or k == batch.num_rows - 1:
                    sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), sizes, pa.array(counts.sums(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
                    start, texts, chars = k + 1, [], 0

    read = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = read.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
