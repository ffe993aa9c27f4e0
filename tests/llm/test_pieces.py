import random

import public_tokenizers
import pytest
import sentencepiece

from sitespec.llm.pieces import PieceCodec, PieceModel, encode_pieces, model_bytes, piece_round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids int, n_pieces string"


@pytest.fixture(scope="module")
def both():
    data = model_bytes(PATH)
    return PieceCodec(data, memory=50), sentencepiece.SentencePieceProcessor(model_proto=data)


def texts():
    chance = random.Random(8)
    parts = ["a", "the ", " ", "  ", "\n", "\t", "▁", "é", "中文", "<s>", "</s>", "<0x41>", "😀", "x" * 9, "　", "\x00", "ing", "12"]
    return ["", " ", "   ", "▁", "plain words", "x" * 20_000] + ["".join(chance.choices(parts, k=chance.randrange(30))) for _ in range(3000)]


def test_parity_with_the_original(both):
    codec, original = both
    assert codec.by_word
    for _ in range(2):
        got = codec.encode(texts())
        assert [x.tolist() for x in got] == original.encode(texts())
    assert [codec.decode(x) for x in got] == original.decode([x.tolist() for x in got])
    assert [codec.whole.decode(x.tolist()) for x in got[:500]] == [codec.decode(x) for x in got[:500]]


def _field(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value)


def test_unigram_models_are_rebuilt(both):
    """A hand-made unigram model: best path by scores, byte fallback, dummy prefix and trimming."""
    import struct

    pieces = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256))]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("ab", -5.0, 1), ("▁a", -4.5, 1), ("▁ab", -9.5, 1), ("ba", -6.0, 1)]
    data = b"".join(
        _field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in pieces
    )
    data += _field(2, 2, _field(3, 0, 1) + _field(35, 0, 1)) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 1))
    codec, original = PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert PieceModel(data).kind == 1 and not codec.by_word
    tried = ["ab", "abab ba", "  a   b ", "aé", "", "bab aab abba"]
    assert [x.tolist() for x in codec.encode(tried)] == original.encode(tried)


def test_tables(spark):
    rows = [(100, "some text", 1, "x"), (100, "some text", 1, "x"), (None, None, 1, "x"), (7, "  é\n ", 1, "x"), (200, "", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = piece_round_trip(docs, PATH).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert {(r.doc_id, r.parity) for r in got} == {(100, True), (None, None), (7, None), (200, True)}
    original = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in encode_pieces(docs, PATH).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert r.ids == original.encode(text or "") and r.n_pieces == len(r.ids)
    assert piece_round_trip(docs.limit(0), PATH).collect() == []


def test_each_row_of_the_query_is_checked(spark, tmp_path):
    from sitespec.llm.queries import op10_sentencepiece

    rows = [(7, "some text"), (7, "some text"), (None, "no id"), (None, None), (101, "  é\n "), (200, ""), (-3, "▁ <s>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.parity is True for r in got)
