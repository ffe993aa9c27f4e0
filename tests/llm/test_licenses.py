import random
import re

import regex

from sitespec.llm.licenses import CHARS_PER_EDIT, NOTICES, PHRASES, Finder, edits_allowed, scan_licenses, seeds

FIND = Finder(PHRASES, NOTICES, CHARS_PER_EDIT)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_places(text):
    have, out = words(text), []
    for phrase, label in PHRASES:
        p = phrase.split()
        out += [(label, i) for i in range(len(have)) if have[i : i + len(p)] == p]
    return sorted(out)


def brute_labels(text):
    joined = " ".join(words(text)).encode().decode("latin-1")
    found = set()
    if len(joined) > 5000:  # one long word: nothing to find, and a search with edits would take minutes
        return found
    for notice, label in NOTICES:
        if regex.search(f"(?:{regex.escape(notice)}){{e<={edits_allowed(notice)}}}", joined):
            found.add(label)
    return found


def corpus():
    chance = random.Random(5)
    filler = ["lorem", "ipsum", "rights", "public", "by", "cc", "all", "é", "x1", "license", "general"]
    out = [
        "", None, "...", "CC-BY", "cc by cc by", "All rights  reserved. ALL RIGHTS\nRESERVED", "x" * 100_000,
        "licence: GNU General Public License v3", "accby cc bye", "éall rights reserved", "Ⱥ cc by",
    ]
    for _ in range(40):
        text = list(" ".join(chance.choices(filler, k=chance.randrange(3, 20))))
        notice = list(chance.choice(NOTICES)[0])
        for _ in range(chance.randrange(0, 9)):
            k = chance.randrange(len(notice))
            notice[k : k + 1] = chance.choice([[], ["q"], [notice[k], "z"]])
        at = chance.randrange(len(text))
        out.append("".join(text[:at] + [" "] + notice + [" "] + text[at:]))
    return out


def test_same_as_search_of_the_whole_text():
    for text in corpus():
        got = FIND(text)
        assert got["n_words"] == len(words(text))
        assert sorted((p["label"], p["word"]) for p in got["places"]) == brute_places(text), text
        assert {n["label"] for n in got["notices"]} == brute_labels(text), text
        for n in got["notices"]:
            assert 0 <= n["start"] < n["end"] <= got["n_words"] and 0 < n["score"] <= 1


def test_seeds_cover_the_notice():
    for notice, _ in NOTICES:
        pieces = seeds(notice, edits_allowed(notice))
        assert "".join(p for _, p in pieces) == notice and len(pieces) == edits_allowed(notice) + 1
        assert all(p for _, p in pieces)


def test_table(spark):
    docs = spark.createDataFrame([(1, "CC BY", 5), (1, "CC BY", 6), (None, None, 7)], "doc_id long, text string, places int")
    rows = scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.places)) for r in rows) == [(0, 0, 0), (1, 2, 1), (1, 2, 1)]
    assert scan_licenses(docs.limit(0)).collect() == []


def test_long_text_of_many_words():
    chance = random.Random(11)
    fill = lambda n: [chance.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(n)]
    chosen = [NOTICES[0], NOTICES[len(NOTICES) // 2], NOTICES[-1]]
    text, spans = [], []
    for (notice, label), before in zip(chosen, (0, 10_000, 10_000), strict=True):
        text += fill(before)
        edited = notice.split()
        edited[1] = edited[1][:-1] + "q"
        spans.append((label, len(text), len(text) + len(edited)))
        text += edited
    phrase, label = PHRASES[0]
    text[15_000:15_000] = phrase.split()
    spans[2] = (spans[2][0], *(x + len(phrase.split()) for x in spans[2][1:]))
    joined = " ".join(text)
    got = FIND(joined)
    assert len(joined) > 100_000 and got["n_words"] == len(text)
    assert (label, 15_000) in [(p["label"], p["word"]) for p in got["places"]]
    assert [(p["label"], p["word"]) for p in got["places"]] == brute_places(joined)
    found = [(n["label"], n["start"], n["end"]) for n in got["notices"]]
    assert all(any(x[0] == y[0] and abs(x[1] - y[1]) <= 1 and abs(x[2] - y[2]) <= 1 for y in found) for x in spans), (spans, found)
