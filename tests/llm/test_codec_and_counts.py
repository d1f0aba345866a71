import pytest
import sentencepiece

from quern.llm.queries import tokenizer_path
from quern.llm.sentencepiece_codec import Codec, decode, encode, read_model
from quern.llm.token_counts import count_tokens

TEXTS = [None, "", " ", "a", " a  b\n c\tx ", "The quick brown fox. " * 3000, "ß é 中文 😀 \x00", "▁literal", "======-----", "x" * 5000, "<s> </s> <unk>", "\n\n\n", "word " * 5 + "\nThe end"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def corpus(sf):
    import duckdb

    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' UNION ALL SELECT text FROM '{sf}/conversations.parquet'").fetchall()]


def test_ids_equal_the_library_and_round_trip(lib, corpus):
    codec = Codec(read_model(tokenizer_path()))
    for t in [*TEXTS, *corpus]:
        assert codec.encode(t) == lib.encode(t or "")
        assert codec.decode(codec.encode(t)) == lib.decode(lib.encode(t or ""))
        if "▁" not in (t or ""):
            assert codec.decode(codec.encode(t)) == (t or "")


def unigram_model():
    """A small unigram model, made by hand: nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.name = "identity"
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(p, s, 1) for p, s in [("▁", -3.0), ("a", -2.5), ("b", -2.6), ("ab", -3.1), ("▁a", -2.9), ("ba", -4.0), ("aba", -4.5), ("c", -5.0), ("bc", -5.5)]]]:
        m.pieces.add(piece=piece, score=score, type=kind)
    return m.SerializeToString()


def best_by_trying(codec, word):
    """Viterbi by definition: the best of all segmentations."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in codec.score:
                options.append((best[start][0] + codec.score[piece], best[start][1] + [codec.ids[piece]]))
        if not any(len(word[s:end]) == 1 and word[s:end] in codec.score for s in range(end)):
            options.append((best[end - 1][0] + codec.lowest - 10, best[end - 1][1] + [-1]))
        best.append(max(options, key=lambda o: o[0]))
    out = []
    for i in best[-1][1]:
        if i >= 0:
            out.append(i)
        elif not (out and out[-1] == codec.unk):
            out.append(codec.unk)
    return out


def test_unigram_viterbi():
    import itertools

    codec = Codec(unigram_model())
    lib = sentencepiece.SentencePieceProcessor(model_proto=unigram_model())
    for n in range(1, 7):
        for letters in itertools.product("abcz", repeat=n):
            word = "".join(letters)
            assert codec.encode_pretoken("▁" + word) == best_by_trying(codec, "▁" + word)
            assert codec.encode(word) == lib.encode(word)


def test_frames(spark, lib):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "x"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a clashing name
    got = decode(spark, encode(spark, docs, tokenizer_path()), tokenizer_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == lib.encode(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded == lib.decode(lib.encode(r.text or ""))
    same = encode(spark, docs, tokenizer_path(), round_trip="same").collect()
    assert all(r.same == (lib.decode(lib.encode(r.text or "")) == (r.text or "")) for r in same) and not all(r.same for r in same)
    counts = count_tokens(spark, docs, tokenizer_path(), limit=100).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(lib.encode(t or ""))) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in counts) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in counts)
    empty = docs.limit(0)
    assert encode(spark, empty, tokenizer_path()).count() == 0 and count_tokens(spark, empty, tokenizer_path(), 1).count() == 0


def test_a_small_table_for_the_task_changes_nothing(spark, corpus):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *corpus])), "doc_id long, text string")
    rows = [sorted(map(tuple, encode(spark, docs, tokenizer_path(), task_entries=n).select("doc_id", "ids", "n_tokens").collect())) for n in (None, 7)]
    assert rows[0] == rows[1]
