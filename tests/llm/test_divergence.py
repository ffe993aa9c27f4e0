import random
import re
from collections import Counter, defaultdict

from sitespec.llm.divergence import SIDE, SLICE, audit_sources, term_counts

SCHEMA = "text string, lang string, source string, term string, rank int"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    counts, lang_counts, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in docs):
        words = [w.translate(LOWER) for w in WORD.findall(text)]
        counts[lang, source].update(words)
        lang_counts[lang].update(words)
        held[lang].update(set(words))
    out = []
    for lang, source in counts:
        kept = [w for w, n in held[lang].items() if n >= least]

        def rates(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = rates(counts[lang, source]), rates(lang_counts[lang])
        others = {s: rates(c) for (g, s), c in counts.items() if g == lang and s != source}
        pairs = [(s, sum(abs(p[w] - r[w]) for w in kept)) for s, r in others.items()]
        terms = [(w, p[w] - q[w]) for w in kept if counts[lang, source][w] and p[w] > q[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i) for i, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_terms_of_a_text():
    assert term_counts("Ab_c äÖ-ab 9x".encode()) == Counter({b"ab": 2, b"c": 1, "äÖ".encode(): 1, b"x": 1})
    assert term_counts(b"") == Counter()
    assert term_counts(b"Word " * SLICE) == Counter({b"word": SLICE})
    assert term_counts(b"x" * (3 * SLICE) + b" y") == Counter({b"x" * (3 * SLICE): 1, b"y": 1})


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "ñandú", "Ärger", "delta", "rare", "x", "zeta"]
    docs = [
        (" ".join(rng.choices(words, weights=[9, 8, 7, 6, 5, 4, 1, 3, 2], k=rng.randrange(12))), rng.choice("ab"), f"s{rng.randrange(4)}")
        for _ in range(120)
    ]
    docs += [docs[0]] * 40 + [(None, "a", "s1"), ("beta", None, None), ("", "", ""), (None, None, "only"), ("1 2 3", "c", "s0"), ("x", "c", "s1")]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    assert rows(audit_sources(frame, least_docs=20, top=3)) == brute(docs, 20, 3)
    assert rows(audit_sources(frame, least_docs=1)) == brute(docs, 1, 50)


def test_more_sources_than_a_block(spark):
    rng = random.Random(6)
    docs = [(" ".join(rng.choices("abcdefgh", k=5)), "l", f"s{i}") for i in range(SIDE + 40)]
    frame = spark.createDataFrame([(*d, "", 0) for d in docs], SCHEMA)
    assert rows(audit_sources(frame, least_docs=20, top=2)) == brute(docs, 20, 2)


def test_empty_table(spark):
    assert rows(audit_sources(spark.createDataFrame([], SCHEMA))) == []
