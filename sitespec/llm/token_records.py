"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A shard is a run of records; the ids of one document are one record:

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the length bytes
    payload  doc_id (8 bytes, signed), width of an id (1 byte: 2 or 4, plus 128 where the row has no doc_id), the
             ids, little-endian
    check    4 bytes: masked CRC-32 of the payload

A checksum is masked (rotated right by 15 bits, plus a constant) so that records may hold checksummed records.
The index ``<shard>.idx`` has one entry of 24 bytes a record: doc_id, offset of the record, number of ids; with
it a reader fetches any record by itself, in any order. Ids take two bytes where the vocabulary allows it.
Rows without doc_id come first; they hold the smallest number in its place, and their number of ids in the index is
negative (a record has one id at least).
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import fresh_folder, materialize, nonce

END_ID = 0
#: Bytes of a shard after which a task begins the next one.
SHARD_BYTES = 64 << 20
#: Words whose ids a worker process remembers, twice: when so many are new, those not asked for since go.
MEMORY = 300_000
#: Longer words aren't remembered, so the memory is bounded in bytes too.
LONGEST = 64
#: Bytes of batches that are looked up together, for a word is asked for once in them; larger batches are cut.
GATHERED = 6 << 20
#: New words that are encoded as one text.
JOINED = 400
_MASK = 0xA282EAD8
#: What stands in the place of a missing doc_id, and the bit beside the width that says so.
NO_ID, _NO_ID_FLAG = -(2**63), 128
#: Letters by every version of Unicode, and a run of them at the begin of a word before an ASCII character that is none.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN, _LETTERS_FIRST = re.compile(f"[{_LETTERS}]").match, re.compile(rf"[{_LETTERS}]+(?=[\x00-@\[-`{{-\x7f])").match
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])


def masked(data: bytes) -> int:
    """The masked checksum of ``data``."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    key, flag = (NO_ID, _NO_ID_FLAG) if doc_id is None else (doc_id, 0)
    payload = struct.pack("<qB", key, ids.dtype.itemsize | flag) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def read_record(source, offset: int | None = None) -> tuple[int | None, np.ndarray] | None:
    """The record at ``offset`` (else at the current place) as doc_id (or None) and ids; None at the end of the shard.

    Raises ValueError where a length or a checksum does not hold.
    """
    if offset is not None:
        source.seek(offset)
    head = bytes(source.read(12))
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = bytes(source.read(size + 4))
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    doc_id, width = struct.unpack("<qB", body[:9])
    ids = np.frombuffer(body[9:size], "<u2" if width & ~_NO_ID_FLAG == 2 else "<u4")
    return None if width & _NO_ID_FLAG else doc_id, ids


class WordEncoder:
    """Encodes whole texts with the tokenizers library, asking it once for each run of characters up to a space.

    The byte-level split puts a boundary before every space that is followed by a character other than white
    space, so a text cut there gives the same ids; what was encoded before is remembered. It puts one behind letters too,
    so of a new word the letters it begins with and the rest are looked up by themselves. What is new goes to the library
    joined, and the ids are cut where the bytes of the tokens add up to the end of a word. Texts of tokenizers
    with a normalizer or another split are encoded whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        # A task has its own core: the library's idle threads would only take time and memory from others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            self.tokenizer = Tokenizer.from_str(file.read())
        largest = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if largest <= 1 << 16 else "<u4")
        split = self.tokenizer.pre_tokenizer
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        added = [t.content for t in tokens]
        self.by_word = (
            type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
            and not any(c.isspace() for text in added for c in text)
            and not any(t.single_word or t.lstrip or t.rstrip for t in tokens)
        )
        self.memory, self.known, self.old = memory, {}, {}
        self.cut = _LETTERS_FIRST if not any(_LATIN(c) for c in added) else lambda word: None
        # Bytes of a token: the byte-level alphabet has one character a byte, added tokens are plain text.
        plain = {c: len(c.encode()) for c in added}
        self.sizes = np.zeros(largest, np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.sizes[number] = plain.get(token, len(token))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a space and another character, many at a time."""
        runs = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for run, found in zip(runs, self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int64)
            ends = np.cumsum([len(w.encode()) for w in run])
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if not len(ids) or cuts[-1] >= len(ids) or not np.array_equal(reached[cuts], ends):
                out += self._encode(run)  # a tokenizer whose tokens don't spell the text
                continue
            data, width, first = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, 0
            for last in ((cuts + 1) * width).tolist():
                out.append(data[first:last])
                first = last
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    @staticmethod
    def units(text: str) -> list[str]:
        """Pieces of the text that join to it, cut before each space that a character other than white space follows."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def _ids(self, keys: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct keys; those that aren't remembered go to ``encode``."""
        known, found = self.known, list(map(self.known.get, keys))
        places = [i for i, ids in enumerate(found) if ids is None]
        missing = [keys[i] for i in places]
        aged = list(map(self.old.get, missing))
        fresh = iter(encode([k for k, ids in zip(missing, aged, strict=True) if ids is None]))
        for i, k, ids in zip(places, missing, aged, strict=True):
            found[i] = ids = next(fresh) if ids is None else ids
            if len(k) <= LONGEST:
                known[k] = ids
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words that a space precedes."""
        return self._ids(words, self._encode_new)

    def _encode_new(self, words: list[str]) -> list[bytes]:
        """Ids of words that a space precedes: of the letters they begin with, and of the rest, each asked for once."""
        ends = [None if w.isalpha() else self.cut(w) for w in words]
        whole = [w for w, m in zip(words, ends, strict=True) if not m]
        firsts = [w[: m.end()] for w, m in zip(words, ends, strict=True) if m]
        rests = [" " + w[m.end() :] for w, m in zip(words, ends, strict=True) if m]
        found = dict(zip(whole, self._encode_words([" " + w for w in whole]), strict=True))
        keys, others = [w for w in dict.fromkeys(firsts) if w not in found], list(dict.fromkeys(rests))
        found.update(zip(keys, self._ids(keys, lambda new: self._encode_words([" " + w for w in new])), strict=True))
        behind = dict(zip(others, self._ids(others, self._encode_rests), strict=True))
        joined = map(bytes.__add__, map(found.__getitem__, firsts), map(behind.__getitem__, rests))
        return [next(joined) if m else found[w] for w, m in zip(words, ends, strict=True)]

    def _encode_rests(self, keys: list[str]) -> list[bytes]:
        """Ids of what follows letters (keys have a space before it); a line end, a token by itself, parts them."""
        rests = [k[1:] for k in keys]
        plain = [r for r in rests if not r[0].isspace() and not r[-1].isspace()]
        found = dict(zip(plain, self._encode_words([r + "\n" for r in plain]), strict=True))
        alone = [r for r in rests if r not in found]
        found = {r: ids[: -self.dtype.itemsize] for r, ids in found.items()} | dict(zip(alone, self._encode(alone), strict=True))
        return [found[r] for r in rests]

    def _heads(self, heads: list[str]) -> list[bytes]:
        """Ids of what texts begin with. Its keys begin with a space, which no word does."""
        keys = list(dict.fromkeys(" " + h for h in heads))
        found = dict(zip(keys, self._ids(keys, lambda new: self._encode([k[1:] for k in new])), strict=True))
        return [found[" " + h] for h in heads]

    def _spaced(self, text: str) -> bytes:
        """Ids of a text with a space before white space or at its end."""
        head, *units = self.units(text)
        words = list(dict.fromkeys(u[1:] for u in units))
        found = dict(zip(words, self._words(words), strict=True))
        return b"".join([*self._heads([head]), *(found[u[1:]] for u in units)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.frombuffer(x, self.dtype) for x in self._encode(texts)]
        if len(self.known) > self.memory:
            self.known, self.old = {}, self.known
        # Arrow cuts the texts behind their first words and numbers the different words of all of them.
        cut = [text.partition(" ") for text in texts]
        lists = pc.split_pattern(pa.array([rest if space else None for _, space, rest in cut], pa.large_string()), " ")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        # A piece that is empty or begins with white space is no word; its texts are looked up by their units.
        spaced = [i for i, w in enumerate(words) if not w or w[0].isspace()]
        for i in reversed(spaced):
            del words[i]
        parts = self._words(words)
        for i in spaced:
            parts.insert(i, b"")
        # The ids of the words stand in one array; each place in a text takes those of its word.
        ids = np.frombuffer(b"".join(parts), self.dtype)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts, lengths = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = ids[np.arange(total) + np.repeat(starts - ends + lengths, lengths)]
        last = np.cumsum(counts)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], last])].tolist()
        units = np.unique(np.searchsorted(last, np.flatnonzero(np.isin(codes, spaced)), "right")).tolist() if spaced else []
        out = [
            np.concatenate([np.frombuffer(head, self.dtype), ids[low:high]])
            for head, low, high in zip(self._heads([head for head, _, _ in cut]), bounds, bounds[1:], strict=False)
        ]
        for k in units:
            out[k] = np.frombuffer(self._spaced(texts[k]), self.dtype)
        return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in tables of ``GATHERED`` bytes or more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process: what one task has encoded, the next ones know."""
    return WordEncoder(path)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``folder`` in ascending doc_id order; return the shard list.

    Rows: part, shard, n_docs, n_tokens, first_id, written to the shared folder. Parts are ranges of doc_id,
    shards of a part follow each other. A shard appears under its name only when it is complete, and each
    attempt of a task writes names of its own; the list names those of the attempt that counted, so a lost
    executor or a second attempt leaves no half-written or doubled shard behind in what is read.
    NULL texts are empty; rows with equal doc_id come in the order of their texts. Rows without doc_id come first,
    by a hash of their texts, so that many of them need not meet in one task; first_id is NULL where a shard begins
    with one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode, part, attempt = word_encoder(tokenizer_path), TaskContext.get().partitionId(), nonce()
        end = np.array([END_ID], encode.dtype)
        out = name = None
        entries: list[tuple[int, int, int]] = []
        at, shard, done = 0, 0, []

        def close():
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx.open") as file:
                file.write(np.array(entries, INDEX).tobytes())
            for end_of in (".idx", ""):
                store.move(f"{root}/{name}{end_of}.open", f"{root}/{name}{end_of}")
            first = None if entries[0][2] < 0 else entries[0][0]
            done.append((part, f"{folder}/{name}", len(entries), sum(abs(e[2]) for e in entries), first))

        for table in gathered(batches):
            keys, texts = table.column(0).to_pylist(), table.column(1)
            step = max(1, 2 * GATHERED * len(keys) // max(1, table.nbytes))
            for low in range(0, len(keys), step):
                for doc_id, ids in zip(keys[low : low + step], encode(texts.slice(low, step).to_pylist()), strict=True):
                    if out is not None and at >= shard_bytes:
                        close()
                        out, entries, at, shard = None, [], 0, shard + 1
                    if out is None:
                        name = f"part-{part:06d}-{shard:04d}-{attempt}.rec"
                        out = store.open_output_stream(f"{root}/{name}.open")
                    record = frame(doc_id, np.concatenate([ids, end]))
                    out.write(record)
                    entries.append((NO_ID, at, -len(ids) - 1) if doc_id is None else (doc_id, at, len(ids) + 1))
                    at += len(record)
        if out is not None:
            close()
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                ["part", "shard", "n_docs", "n_tokens", "first_id"],
            )

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    shards = ordered.mapInArrow(write, "part int, shard string, n_docs long, n_tokens long, first_id long")
    return materialize(shards, "shards")


def read_records(shards: DataFrame) -> DataFrame:
    """Read shards back: one row per record with doc_id, start (ids of all records before it), n_tokens, ids_crc32.

    Every length, checksum and index entry is verified. The shard list is small (one row per ``SHARD_BYTES``);
    its running totals are sums over the rows of each shard's predecessors, kept as one row per shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = arrow_fs.FileSystem.from_uri(shard)
                with store.open_input_stream(f"{name}.idx") as file:
                    index = np.frombuffer(file.read(), INDEX)
                rows = []
                with store.open_input_stream(name) as source:
                    at = 0
                    while (record := read_record(source)) is not None:
                        doc_id, ids = record
                        entry = index[len(rows)]
                        held = (NO_ID, at, -len(ids)) if doc_id is None else (doc_id, at, len(ids))
                        if held != (entry["doc_id"], entry["offset"], entry["n_tokens"]):
                            raise ValueError("the index does not fit the shard")
                        rows.append((held[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        at += 12 + 9 + ids.nbytes + 4
                if len(rows) != len(index):
                    raise ValueError("the index does not fit the shard")
                columns = np.array(rows, np.int64).T
                keys = pa.array(columns[0], mask=index["n_tokens"] < 0)
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns[1:])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = shards.sparkSession
    # One row per shard of SHARD_BYTES: a 100 TB corpus has about a million, of some 100 bytes.
    listed = shards.select("part", "shard", "n_tokens").orderBy("part", "shard").collect()
    placed, total = [], 0
    for row in listed:
        placed.append((row["shard"], total))
        total += row["n_tokens"]
    files = spark.createDataFrame(placed, "shard string, start long")
    if placed:
        files = files.repartition(len(placed))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(shard: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Single records of a shard by doc_id, through the index: the shuffled read of a training job."""
    store, name = arrow_fs.FileSystem.from_uri(shard)
    with store.open_input_stream(f"{name}.idx") as file:
        index = np.frombuffer(file.read(), INDEX)
    index = index[index["n_tokens"] > 0]
    keys, out = index["doc_id"].tolist(), {}
    with store.open_input_file(name) as source:
        for doc_id in doc_ids:
            k = bisect.bisect_left(keys, doc_id)
            if k < len(keys) and keys[k] == doc_id:
                out[doc_id] = read_record(source, int(index["offset"][k]))[1]
    return out


def token_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Encode, write and read back ``docs`` (doc_id long, text); see ``write_records`` and ``read_records``.

    Rows without doc_id are records too, before all others, and are read back with NULL doc_id.

    An empty table gives no shard and no rows; empty and NULL texts are records that hold the end id alone;
    further columns are not looked at.
    """
    return read_records(write_records(docs, folder or fresh_folder(docs.sparkSession, "records"), tokenizer_path))
