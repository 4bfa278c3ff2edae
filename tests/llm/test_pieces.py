"""Merge-type encoding against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import pieces
from pairloom.llm.common import tokenizer_path
from pairloom.llm.pieces import MergeEncoder, encode_digests, encode_documents

SCHEMA = "doc_id long, text string, ids string, decoded long"
TEXTS = [None, "", " ", "  ", "a  b", "\n\t\0", "▁a▁ ▁", "<s>x</s> <unk> <0x41>", "Ünïcödé 漢字 🙂🙃 ​", "0123 4567.89", "x" * 5000, "ab " * 40_000, "퟿￿\U0010ffff", "same", "same", "don't stop\r\n\r\nnow", "áé", "ⅷ ﬁ Ａ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))


@pytest.fixture(scope="module")
def ours():
    return MergeEncoder(tokenizer_path(pieces.MODEL))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\n.aeiontrs'th")), max_size=120))
def test_any_text_is_encoded_as_by_the_library(text):
    e = pieces.encoder(tokenizer_path(pieces.MODEL))
    assert e.encode([text]) == [e.library.encode(text)]
    assert e.decoded(text, e.library.encode(text)) == e.library.decode(e.library.encode(text))


def test_agenda_on_whole_texts_agrees_with_parts(ours, library):
    for t in TEXTS[1:]:
        if len(t) < 6000:
            assert ours.merged(library.normalize(t)) == library.encode(t)


def test_digests_of_odd_texts(spark, library):
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = encode_digests(docs).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(got) == len(TEXTS)
    by = {r.doc_id or 0: r for r in got}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_ids_and_decoded_texts(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    for r in encode_documents(docs).collect():
        assert r.ids == library.encode(TEXTS[r.doc_id] or "")
        assert r.decoded == library.decode(r.ids)
    assert encode_documents(docs.where(F.lit(False))).count() == 0


def test_matrix_of_agendas_agrees_with_the_heap(ours):
    rng = random.Random(2)
    pieces_ = [p for p in ours.symbol if len(p) > 1]
    parts = ["".join(rng.choice(pieces_) for _ in range(rng.choice([1, 2, 4])))[: rng.choice([2, 5, 9, 17, 40])] for _ in range(3000)] + ["▁" * n for n in range(1, 41)] + ["s" * n for n in range(1, 41)]
    assert ours.merged_together(parts) == [ours.merged(p) for p in parts]


def test_memory_of_parts_is_bounded(monkeypatch, library):
    monkeypatch.setattr(pieces, "PARTS", 5)
    e = MergeEncoder(tokenizer_path(pieces.MODEL))
    text = " ".join(f"word{chr(97 + i)}" for i in range(26))
    for t in (text, text, "word" + text):
        assert e.encode([t]) == [library.encode(t)]
        assert len(e.known) <= 40 and len(e.older) <= 40


def test_a_difference_to_the_library_ends_the_job(monkeypatch):
    e = MergeEncoder(tokenizer_path(pieces.MODEL))
    with pytest.raises(ValueError, match="otherwise"):
        e.agreed(["▁hello"], [[1, 2]])
    with pytest.raises(ValueError, match="otherwise"):
        e.agreed(["hello"], [[1, 2]])
    with pytest.raises(ValueError, match="decode"):
        e.decoded("hello", e.library.encode("hallo"))
    monkeypatch.setattr(e, "merged_together", lambda parts: [[5]] * len(parts))
    with pytest.raises(ValueError, match="otherwise"):
        e.encode(["some text"])


def test_texts_are_handed_over_in_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 4)
    assert list(pieces.in_blocks(["ab", "c", "def", "", "ghijklm"])) == [["ab", "c", "def"], ["", "ghijklm"]]
