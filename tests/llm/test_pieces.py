import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import pieces as p

SMALL = [("<unk>", 0.0, p.UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, p.BYTE) for b in range(256)] + [(x, s, p.NORMAL) for x, s in [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -2.2), ("▁ab", -4.0), ("ba", -2.0), ("aba", -3.5), ("é", -4.0), ("bab", -6.0)]]
INNER = [*SMALL, ("b▁a", -1.0, p.NORMAL)]


def best_score(codec, text, literal):
    """By dynamic programming over all pieces at all places."""
    usable = {x: s for x, s, kind in codec.pieces if kind == p.NORMAL}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in usable and not any(k in literal for k in range(start, end)):
                best[end] = max(best[end], best[start] + usable[piece])
        if text[end - 1] not in usable or end - 1 in literal:
            best[end] = max(best[end], best[end - 1] + codec.penalty)
    return best[-1]


def score_of(codec, ids):
    total, at = 0.0, 0
    while at < len(ids):
        x, s, kind = codec.pieces[ids[at]]
        if kind == p.BYTE:
            first = int(x[3:5], 16)
            at += 1 if first < 128 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            total += codec.penalty
        else:
            total, at = total + s, at + 1
    return total


@pytest.mark.parametrize("vocabulary", [SMALL, INNER], ids=["by word", "whole text"])
def test_small_vocabularies(vocabulary):
    codec, r = p.Codec(vocabulary), random.Random(7)
    assert codec.by_word == (vocabulary is SMALL)
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "ab", " ", "é", "ß", "▁", "漢", "\n", "😀"]) for _ in range(r.randrange(1, 14)))
        ids = codec.encode(text)
        written = p.SPACE + text.replace(" ", p.SPACE)
        assert abs(score_of(codec, ids) - best_score(codec, written, {i + 1 for i, c in enumerate(text) if c == p.SPACE})) < 1e-9
        assert codec.decode(ids) == text


CODEC = p.Codec(p.load())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("abc é\n.,▁", max_size=60))
def test_any_text_comes_back(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC.decode(CODEC.encode(text)) == text


def test_the_file_is_read_as_the_library_reads_it():
    library = sentencepiece.SentencePieceProcessor(model_file=p.MODEL_FILE)
    assert [(x, s) for x, s, _ in CODEC.pieces] == [(library.id_to_piece(i), library.get_score(i)) for i in range(library.vocab_size())]
    ids = CODEC.encode("The quick brown fox, über 漢字 and 😀.")
    assert library.decode(ids) == CODEC.decode(ids) == "The quick brown fox, über 漢字 and 😀."


def test_documents(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "a" * 100_000 + " b" * 50_000), (4, "a" * 100_000 + " b" * 50_000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as e")
    got = p.encode_documents(df).collect()
    assert len(got) == 6 and all(g.round_trip for g in got)
    by = {g.doc_id: g for g in got}
    assert by[2].token_ids is None and by[2].n_tokens == 0 and by[3].token_ids == [] and by[1].token_ids == CODEC.encode("hello world").tolist()
    back = p.encode_documents(df).select("doc_id", p.decoder(spark)("token_ids").alias("text")).collect()
    assert sorted(map(str, back)) == sorted(map(str, df.select("doc_id", "text").collect()))
    assert p.encode_documents(df.limit(0)).collect() == []
