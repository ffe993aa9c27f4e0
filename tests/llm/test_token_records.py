import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitespec.llm.token_records import WordEncoder, fetch, frame, read_record, token_records, write_records

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Plain words, and more.", "", None, "  two  spaces ", " ", "tab\tline\n\nnext\n x", "it's we'll 12 34",
    "a b 　 c", "<|endoftext|> in a text", "é中文 — ok", "x" * 5000, "Plain words, and more.", "a \x1cb \x85 c",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def expected(whole, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_give_the_ids_of_the_whole_text(whole):
    texts = [t or "" for t in TEXTS]
    encode = WordEncoder(PATH, memory=3)
    for _ in range(3):
        assert [x.tolist() for x in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_written_and_read_back(spark, whole, tmp_path):
    rows = [(7 * i % 31, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, start string, shard int")
    got = token_records(docs.repartition(3), PATH, f"file://{tmp_path}/records")
    assert sorted(map(tuple, got.collect())) == expected(whole, rows)


def test_many_shards_keep_the_order(spark, whole, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_records(docs, f"file://{tmp_path}/records", PATH, shard_bytes=20_000)
    assert shards.count() > 10
    from sitespec.llm.token_records import read_records

    want = expected(whole, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, read_records(shards).collect())) == want
    first = shards.orderBy("first_id").first()
    some = fetch(first["shard"], [first["first_id"], -1])
    assert [len(x) for x in some.values()] == [want[0][2]]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_records(docs, PATH, f"file://{tmp_path}/records").collect() == []


def test_damage_is_found():
    record = bytearray(frame(5, np.array([1, 2, 3], "<u2")))
    assert read_record(io.BytesIO(record))[1].tolist() == [1, 2, 3]
    for place in (0, 9, 14, len(record) - 1):
        broken = bytearray(record)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            read_record(io.BytesIO(broken))
    with pytest.raises(ValueError):
        read_record(io.BytesIO(record[:-6]))


def test_rows_without_id_come_first(spark, whole, tmp_path):
    rows = [(None, "no id"), (None, None), (None, "no id"), (-(2**63), "the smallest id"), (5, "five"), (-1, "below")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = write_records(docs, f"file://{tmp_path}/records", PATH, shard_bytes=1)
    from sitespec.llm.token_records import read_records

    got = sorted(read_records(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, -(2**63), -1, 5]
    alone = {i: expected(whole, [(i, t)])[0][2:] for i, t in rows if i is not None}
    assert all((r.n_tokens, r.ids_crc32) == alone[r.doc_id] for r in got[3:])
    assert sorted((r.n_tokens, r.ids_crc32) for r in got[:3]) == sorted(expected(whole, [(0, t)])[0][2:] for i, t in rows if i is None)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    whole_shard = write_records(docs.coalesce(1), f"file://{tmp_path}/one", PATH)
    found = [ids for r in whole_shard.collect() for ids in fetch(r["shard"], [-(2**63)]).values()]
    assert [x.tolist()[:-1] for x in found] == [whole.encode("the smallest id", add_special_tokens=False).ids]


def test_a_line_end_behind_a_space_is_kept(whole):
    texts = ["b", "a \nb", "a \n b ", "\nb b", "b's b.\n\nb, b\n.\nb", "<|endoftext|>b b<|endoftext|>b b<|endoftext|>", "éa9 ß'll x\n"]
    encode = WordEncoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode([]) == []


def test_letters_of_a_word_are_asked_for_once(whole):
    encode, asked = WordEncoder(PATH), []
    ask = encode._encode_words
    encode._encode_words = lambda words: asked.extend(words) or ask(words)
    texts = ["x thbleon thbleon, thbleon. thbleon.\nAnd", "x thbleon! thbleon, other"]
    assert [x.tolist() for t in texts for x in encode([t])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w for w in asked if "thbleon" in w] == [" thbleon"]
