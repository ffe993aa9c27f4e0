"""SentencePiece models run by the tokenizers library: the model file is parsed and its parts are rebuilt."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitespec.llm.common import release_memory

SPACE = "▁"
# Numbers of the published model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads that a batch is encoded with (the cores of a task), and words whose ids a worker process remembers, twice.
THREADS, MEMORY = 1, 300_000
#: New words that are encoded as one text.
JOINED = 400


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def message(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Field numbers and values of one protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if kind == 1 else "<f", data[at : at + size])[0], at + size
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


class PieceModel:
    """What a model file says: pieces with scores and kinds, the algorithm, and how texts are normalised."""

    def __init__(self, data: bytes):
        fields = list(message(data))
        rows = [dict(message(v)) for k, v in fields if k == 1]
        trainer = dict(message(next((v for k, v in fields if k == 2), b"")))
        normalizer = dict(message(next((v for k, v in fields if k == 3), b"")))
        self.pieces = [(r.get(1, b"").decode(), r.get(2, 0.0), r.get(3, NORMAL)) for r in rows]
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be rebuilt")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        if not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models without the space marker, or with it behind words, can't be rebuilt")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first: what BPE training has left in the scores."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        out = []
        for piece, number in usable.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if a in usable and b in usable:
                    out.append((-self.pieces[number][1], number, k, a, b))
        return [(a, b) for *_, a, b in sorted(out)]

    def tokenizer(self):
        """The whole model as a tokenizer: normalizer, space marker, scores or merges, byte fallback, decoder."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            unknown = self.pieces[self.unknown][0]
            model = models.BPE(vocabulary, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        steps = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        own = [p for p, _, kind in self.pieces if kind == USER_DEFINED]
        if own:
            out.add_tokens(own)
        return out


class PieceCodec:
    """Encodes and decodes batches of texts.

    Where no piece holds the space marker behind another character, no merge and no best path crosses a space, so
    words are encoded by themselves and remembered; texts with runs of spaces, and all texts of other models, go
    whole. The library encodes what is new in one batch, on ``threads`` threads: new words go joined, and the ids are
    cut before each piece that begins with the marker.
    """

    def __init__(self, data: bytes, threads: int = THREADS, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = str(threads > 1).lower(), str(threads)
        self.model = PieceModel(data)
        self.whole = self.model.tokenizer()
        self.words = self.model.tokenizer()
        from tokenizers import normalizers

        self.words.normalizer = normalizers.Sequence([])
        m = self.model
        self.by_word = (
            m.dummy_prefix and not m.charsmap and not m.trim
            and not any(SPACE in p.lstrip(SPACE) or kind == USER_DEFINED for p, _, kind in m.pieces)
        )
        self.memory, self.known, self.old = memory, {}, {}
        self.begins = np.array([p.startswith(SPACE) for p, _, _ in m.pieces])
        self.surface = [
            bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL
            else m.unknown_text.encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, kind in m.pieces
        ]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without a space marker, many joined at a time: each begins at the only piece with a marker."""
        runs = [[SPACE + w for w in words[i : i + JOINED]] for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for run, found in zip(runs, self.words.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<i4")
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(run) or (len(first) and first[0] != 0):  # a vocabulary without the marker itself
                out += [np.array(e.ids, "<i4").tobytes() for e in self.words.encode_batch_fast(run, add_special_tokens=False)]
                continue
            data, cuts = ids.tobytes(), [*(first * 4).tolist(), ids.nbytes]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the original library gives them without begin and end marks."""
        if len(self.known) > self.memory:
            self.known, self.old = {}, self.known
        cut = [text.split(" ") if self.by_word and text and SPACE not in text else [""] for text in texts]
        found = [list(map(self.known.get, parts)) for parts in cut]
        gaps = [i for i, ids in enumerate(found) if None in ids]
        new = {p for i in gaps for p, ids in zip(cut[i], found[i], strict=True) if ids is None}
        new.discard("")  # never remembered: a text with a run of spaces is always seen here
        again = {p: ids for p in new if (ids := self.old.get(p)) is not None}
        self.known.update(again)
        new = [p for p in new if p not in again]
        self.known.update(zip(new, self._encode_words(new), strict=True))
        whole = [i for i in gaps if "" in cut[i]]
        ids = self.whole.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        for i, e in zip(whole, ids, strict=True):
            found[i] = [np.array(e.ids if texts[i] else [], "<i4").tobytes()]
        for i in gaps:
            if "" not in cut[i]:
                found[i] = list(map(self.known.__getitem__, cut[i]))
        return [np.frombuffer(b"".join(parts), "<i4") for parts in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, the mark before the first word taken off."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


def model_bytes(path: str) -> bytes:
    """A model file from the driver's disk; it is small (a vocabulary) and goes to tasks with their code."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def _codec(data: bytes, threads: int, memory: int = MEMORY) -> PieceCodec:
    """The codec of a worker process: what one task has encoded, the next ones know."""
    return PieceCodec(data, threads, memory)


def encode_pieces(docs: DataFrame, model_path: str, threads: int = THREADS, memory: int = MEMORY) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces) of ``docs`` (doc_id, text); NULL and empty texts have no ids.

    ``memory`` is the number of words whose ids a worker process remembers, twice.

    Each row is encoded by itself: nothing is shuffled, repeated rows and NULL ids stay. Other columns are not
    looked at.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, threads, memory)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes)], ["doc_id", "ids", "n_pieces"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_pieces long")


def piece_round_trip(docs: DataFrame, model_path: str, every: int = 100, threads: int = THREADS) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip, parity): encode, decode, and verify whole texts.

    ``round_trip`` holds where the decoded text is the text (NULL read as empty); ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers. ``parity`` says that the original library gives the same ids and decodes
    them to the same text: with ``every`` 1 for each row, whatever its id; else for documents whose id is divisible
    by ``every``, and NULL for the others.
    """
    import hashlib

    shipped = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        data = shipped.value
        codec, original = _codec(data, threads), sentencepiece.SentencePieceProcessor(model_proto=data)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for key, text, ids in zip(keys, texts, codec.encode(texts), strict=True):
                    decoded = codec.decode(ids)
                    parity = None
                    if every == 1 or (key is not None and key % every == 0):
                        listed = ids.tolist()
                        parity = original.encode(text) == listed and original.decode(listed) == decoded
                    digest = hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, len(ids), zlib.crc32(ids.tobytes()), digest, decoded == text, parity))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip", "parity"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
