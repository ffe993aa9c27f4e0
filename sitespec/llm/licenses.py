"""License scans: exact phrases by words, and short notices found with a bounded number of edits."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that stand word by word, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Short notices of published licenses, in words, with their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("all rights reserved", "reserved"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
RESULT = (
    "struct<n_words:long,places:array<struct<label:string,word:long>>,"
    "notices:array<struct<label:string,start:long,end:long,edits:int,score:double>>>"
)


def edits_allowed(notice: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(notice) // chars_per_edit


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in ``edits + 1`` pieces with their offsets: with so few edits, one piece at least stays as it is."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Seeds of all notices in one automaton, and the verifying patterns."""

    def __init__(self, phrases: tuple, notices: tuple, chars_per_edit: int):
        self.phrases = [(f" {p} ", label) for p, label in phrases]
        self.notices, self.halves = [], []
        self.seeds = ahocorasick.Automaton()
        wanted: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices):
            edits = edits_allowed(notice, chars_per_edit)
            fuzzy = regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={edits}}}")
            halves = [piece for _, piece in seeds(notice, 2 * edits + 1)]
            self.notices.append((notice, label, edits, fuzzy))
            self.halves.append(halves)
            for offset, piece in seeds(notice, edits):
                wanted.setdefault(piece, []).append((number, offset))
        for piece, places in wanted.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    @staticmethod
    def words(text: str | None) -> str:
        """The words of a text between single spaces, one byte of UTF-8 a character."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        return b" ".join(words).decode("latin-1")

    def windows(self, words: str) -> dict[int, list[list[int]]]:
        """For each notice, the runs of the text that a seed says may hold it, merged where they overlap."""
        out: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(words):
            for number, offset in places:
                notice, _, edits, _ = self.notices[number]
                low = end + 1 - size - offset - edits
                high = low + len(notice) + 2 * edits
                runs = out.setdefault(number, [])
                runs.append([max(0, low), min(len(words), high)])
        for number, runs in out.items():
            runs.sort()
            merged = [runs[0]]
            for low, high in runs[1:]:
                if low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            out[number] = merged
        return out

    def __call__(self, text: str | None) -> dict:
        words = self.words(text)
        padded = f" {words} "
        places = []
        for phrase, label in self.phrases:
            at, seen, low = padded.find(phrase), 0, 1
            while at >= 0:
                seen += padded.count(" ", low, at + 1)
                low = at + 1
                places.append({"label": label, "word": seen})
                at = padded.find(phrase, at + 1)
        found = []
        for number, runs in self.windows(words).items():
            notice, label, edits, fuzzy = self.notices[number]
            for low, high in runs:
                # Pigeonhole once more: of 2 * edits + 2 pieces, edits + 2 at least stay as they are.
                window = words[low:high]
                if sum(piece in window for piece in self.halves[number]) < edits + 2:
                    continue
                at = low
                while (m := fuzzy.search(words, at, high)) is not None:
                    made = sum(m.fuzzy_counts)
                    found.append(
                        {
                            "label": label, "start": words.count(" ", 0, m.start()), "end": words.count(" ", 0, m.end()) + 1,
                            "edits": made, "score": 1 - made / len(notice),
                        }
                    )
                    at = max(m.end(), at + 1)
        found.sort(key=lambda f: (f["start"], f["end"], f["label"], f["edits"]))
        return {"n_words": words.count(" ") + 1 if words else 0, "places": places, "notices": found}


@lru_cache(maxsize=4)
def _finder(phrases: tuple, notices: tuple, chars_per_edit: int) -> Finder:
    return Finder(phrases, notices, chars_per_edit)


def license_finds(
    text: Column, phrases: tuple = PHRASES, notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT
) -> Column:
    """What a text says about its license: number of words, places of the phrases, and notices with few edits.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; ``places`` are exact, word by
    word. A notice with at most ``len / chars_per_edit`` edits keeps one of ``edits + 1`` pieces unchanged, so an
    automaton over all pieces locates every candidate, and the regex library's bounded-error matching decides
    within the candidate's window, preferring fewer edits. Notices report words [start, end), edits and
    ``1 - edits / length``. NULL and empty texts have no words and no finds. Each text is a row by itself:
    nothing is shuffled.
    """
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    notice = pa.struct(
        [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]
    )
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(place)), ("notices", pa.list_(notice))])

    def scan(texts: pa.Array) -> pa.Array:
        find = _finder(phrases, notices, chars_per_edit)
        return pa.array([find(t.as_py()) for t in texts], kind)

    return F.arrow_udf(scan, RESULT)(text)


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, n_words, places, notices) of ``docs`` (doc_id, text); repeated and NULL ids give their own rows."""
    return docs.select("doc_id", license_finds(F.col("text"), **options).alias("found")).select("doc_id", "found.*")
