"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds all pieces. One pass over a pre-token follows its output
links, so that at each position all pieces that end there are relaxed:

* unigram models: best[end] = max(best[start] + score), the Viterbi path;
* BPE models: scores there are merge ranks, and the best sum of ranks is not
  what merging gives. By a property of merging, the pieces of any prefix are
  those of a shorter prefix and one more piece, and a sequence is the result
  of merging just if each two neighbours stay apart when merged alone. So the
  relaxation takes the piece that ends here and stays apart from the last
  piece at its start: again one state a position, in a single pass.

Both give the ids of the sentencepiece library for the same model file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Distinct pre-tokens, and pairs of pieces, that one Python worker remembers.
CACHE_ENTRIES = 300_000
#: The model is broadcast; larger files are refused.
MAX_MODEL_BYTES = 64 << 20
#: Texts are handed back in Arrow batches of about so many ids.
BATCH_IDS = 500_000


def splitter(pieces: Collection[str]) -> Callable[[str], list[str]]:
    """Cuts normalised text into pre-tokens that can be encoded alone.

    Where no piece holds white space after another character, nothing merges
    across the start of a run of white space; nor across a line end or tab that
    is in no piece at all.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return lambda s: [s] if s else []
    barriers = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces))
    word = f"[^{SPACE}{barriers}]"
    return re.compile(f"{SPACE}+{word}*|{word}+" + (f"|[{barriers}]" if barriers else "")).findall


class Codec:
    """Encodes and decodes with the model in the given serialized bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not supported")
        self.bpe = proto.trainer_spec.model_type == 2
        if not self.bpe and proto.trainer_spec.model_type != 1:
            raise ValueError("only unigram and BPE models are supported")
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]  # 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte
        if 4 in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.unk = kinds.index(2)
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, kind in enumerate(kinds):
            if kind == 6:
                self.byte_of[i] = int(self.pieces[i][3:5], 16)
                self.bytes[self.byte_of[i]] = i
        self.fallback = proto.trainer_spec.byte_fallback and len(self.byte_of) == 256
        #: What each piece is decoded to.
        self.raw = [bytes([self.byte_of[i]]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode() for i, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True))]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.lowest = min(self.score.values(), default=0.0)
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}  # of a BPE piece: what its last merge joins
        self.ordered: set[str] = set()  # BPE pieces all of whose merges come in the order of their scores
        for piece, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            # a BPE piece that merging its own characters doesn't give can never be in a result
            if not self.bpe or len(piece) == 1 or self._merged(piece):
                self.automaton.add_word(piece, (len(piece), i))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}  # by both ids: whether the two stay apart
        self.split = splitter(self.ids)

    def normalize(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.dummy_prefix else text

    def pretokens(self, text: str) -> list[str]:
        return self.split(self.normalize(text))

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.pretokens(text or "") for i in self.encode_pretoken(word)]

    def encode_pretoken(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        path = self._bpe_path(word) if self.bpe else self._viterbi_path(word)
        out: list[int] = []
        for i, char in path:
            if i >= 0:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
            elif not (out and out[-1] == self.unk):  # the library joins neighbouring unknown characters
                out.append(self.unk)
        return out

    def _hits(self, word: str):
        """(last position, (length, id)) of every piece in word: by end, the longest first."""
        return self.automaton.iter(word) if len(self.automaton) else ()

    def _viterbi_path(self, word: str) -> list[tuple[int, str]]:
        n = len(word)
        best, back = [0.0] + [None] * n, [(0, -1)] * (n + 1)
        unknown, at = self.lowest - 10.0, 0  # the library's score of an unknown character
        single = [False] * (n + 1)

        def close(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                if not single[at] and (best[at] is None or best[at - 1] + unknown > best[at]):
                    best[at], back[at] = best[at - 1] + unknown, (at - 1, -1)

        for end, (length, i) in self._hits(word):
            close(end)
            single[end + 1] |= length == 1
            score = best[end + 1 - length] + self.score[self.pieces[i]]
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (end + 1 - length, i)
        close(n)
        return self._walk(word, back)

    def _bpe_path(self, word: str) -> list[tuple[int, str]]:
        n = len(word)
        last, length_of = [-1] * (n + 1), [1] * (n + 1)  # where no piece ends: an unknown character
        apart = self.apart
        for end, (length, i) in self._hits(word):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before >= 0:
                ok = apart.get(before << 24 | i)
                if ok is None:
                    ok = self._stays_apart(before, i)
                if not ok:
                    continue
            last[end], length_of[end] = i, length
        out = []
        while n:
            start = n - length_of[n]
            out.append((last[n], word[start:n]))
            n = start
        return out[::-1]

    @staticmethod
    def _walk(word: str, back: list[tuple[int, int]]) -> list[tuple[int, str]]:
        out, end = [], len(word)
        while end:
            start, i = back[end]
            out.append((i, word[start:end]))
            end = start
        return out[::-1]

    def _stays_apart(self, a: int, b: int) -> bool:
        left, right = self.pieces[a], self.pieces[b]
        if (len(left) == 1 or left in self.ordered) and (len(right) == 1 or right in self.ordered):
            known = self._never_meet(left, right)
        else:
            known = self._merge(left + right) == [left, right]
        if len(self.apart) >= CACHE_ENTRIES:
            self.apart.clear()
        self.apart[a << 24 | b] = known
        return known

    def _merged(self, piece: str) -> bool:
        """Whether merging a piece's characters gives it; notes its halves then."""
        halves = self._merge(piece, keep_last=True)
        if len(halves) != 2:
            return False
        left, right = halves
        self.halves[piece] = left, right
        rank = self.score[piece]
        if all(len(x) == 1 or x in self.ordered and self.score[x] > rank for x in halves):
            self.ordered.add(piece)
        return True

    def _never_meet(self, left: str, right: str) -> bool:
        """Undoes the merges of both pieces, the latest first, and looks whether
        the two symbols at the border would have been merged before the next
        merge of either. Of equal scores the leftmost pair goes first."""
        score = self.score
        until, on_left = -1e300, True  # the next merge at the border: its score and side
        while True:
            across = score.get(left + right)
            if across is not None and (across > until or across == until and not on_left):
                return False
            a = score[left] if len(left) > 1 else 1e300
            b = score[right] if len(right) > 1 else 1e300
            if a == b == 1e300:
                return True
            if a < b:
                until, on_left, left = a, True, self.halves[left][1]
            else:
                until, on_left, right = b, False, self.halves[right][0]

    def _merge(self, text: str, keep_last: bool = False) -> list[str]:
        """Merging by definition, of at most two pieces: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            at = max(range(len(parts) - 1), key=lambda k: (self.score.get(parts[k] + parts[k + 1], -1e300), -k))
            if (joined := parts[at] + parts[at + 1]) not in self.score or keep_last and len(parts) == 2:
                break
            parts[at : at + 2] = [joined]
        return parts

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        if self.dummy_prefix and ids and self.pieces[ids[0]].startswith(SPACE):
            text = text[1:]
        return text


class _Cache(dict):
    """Pre-token to its ids as int32 bytes; bounded."""

    def __init__(self, codec: Codec, entries: int):
        self.codec, self.entries = codec, entries

    def __missing__(self, word: str) -> bytes:
        import numpy as np

        ids = np.array(self.codec.encode_pretoken(word), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[word] = ids
        return ids


_WORKER: dict[bytes, tuple[Codec, _Cache]] = {}


def _codec(model: bytes) -> tuple[Codec, _Cache]:
    """One codec for each Python worker, which runs many tasks."""
    if model not in _WORKER:
        _WORKER.clear()
        codec = Codec(model)
        _WORKER[model] = codec, _Cache(codec, CACHE_ENTRIES)
    return _WORKER[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has {len(model)} bytes; at most {MAX_MODEL_BYTES} are broadcast")
    return model


def encode(spark: SparkSession, docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", round_trip: str | None = None, task_entries: int | None = None) -> DataFrame:
    """Adds ids (array of int, no begin or end marks) and n_tokens (long) to docs.

    With round_trip, also a column of that name: whether decoding the ids gives
    the text again, decided in the same pass.

    No shuffle; the model (size-checked) is broadcast. Each Python worker keeps
    the ids of the pre-tokens it met, in a bounded table, for the tasks to come.
    With task_entries, it keeps at most so many and gives up them and the model
    when a task ends: less memory for the jobs that follow, and more CPU time
    here; the result is the same. A null or empty text
    has an empty array. A lone text of any length is one row. Columns with
    those two names are replaced; all others stay, whatever they are called.
    """
    model = spark.sparkContext.broadcast(read_model(model_path))
    kept = [f for f in docs.schema.fields if f.name not in (ids, "n_tokens", round_trip)]
    # positions, not names, go through Python: names may clash in any way there
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField("n_tokens", T.LongType(), False)]
    added += [T.StructField(round_trip, T.BooleanType(), False)] if round_trip else []
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec, cache = _codec(model.value)
        if task_entries:
            cache = _Cache(codec, task_entries)
            _WORKER.clear()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rest = batch.columns[:-1]
            start, parts, same, n = 0, [], [], 0
            for k in range(batch.num_rows):
                t = texts[k].as_py() or ""
                parts.append(b"".join([cache[w] for w in codec.pretokens(t)]))
                if round_trip:
                    same.append(codec.decode(np.frombuffer(parts[-1], np.int32).tolist()) == t)
                n += len(parts[-1]) // 4
                if n >= BATCH_IDS or k == batch.num_rows - 1:
                    sizes = np.array([len(p) // 4 for p in parts], np.int64)
                    flat = pa.array(np.frombuffer(b"".join(parts), np.int32))
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    out = [c.slice(start, len(parts)) for c in rest]
                    out += [pa.ListArray.from_arrays(offsets, flat), pa.array(sizes)] + [pa.array(same, pa.bool_())] * bool(round_trip)
                    yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])
                    start, parts, same, n = k + 1, [], [], 0

    own = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"))
    return own.mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, model_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids; a null array gives null. No shuffle."""
    model = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, _ = _codec(model.value)
        for rows in parts:
            yield pa.array([None if x is None else codec.decode(x) for x in rows.to_pylist()], pa.string())

    return encoded.withColumn(to, run(F.col(f"`{ids}`")))
