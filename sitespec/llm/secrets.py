"""Secret scans: rules as regular expressions, found through a trigram inverted index over blocks of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import release_memory

#: Texts and bytes of a block: one segment of the index. A longer text is a block by itself.
BLOCK_TEXTS, BLOCK_BYTES = 512, 4 << 20
#: A set of strings that grows beyond this is turned into trigrams and started anew.
EXACT = 16
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches from left to right without overlap; those whose group ``group`` is too short go."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    def spans(self, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Published token formats, added to the base kinds.
ADDED = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

# A query is True (every text), a trigram, or ("and" | "or", its parts).


def _join(kind: str, parts: list) -> object:
    if kind == "or" and True in parts:
        return True
    parts = sorted({p for p in parts if p is not True}, key=repr)
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """What a text holds that holds one of the strings, in lower case."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _class(items: list) -> set[str] | None:
    """The characters of a small class in lower case; None for a large or negated one."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < EXACT:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= EXACT else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """The strings that a pattern matches exactly, if they are few, and the query that any match fulfils."""
    exact: set[str] = {""}
    queries: list = []

    def flush(strings: set[str]) -> None:
        queries.append(_of_strings(strings))

    whole = True
    for kind, value in tree:
        some: set[str] | None = None
        query: object = True
        if kind is op.LITERAL:
            some = {chr(value).lower()}
        elif kind is op.IN:
            some = _class(value)
        elif kind is op.SUBPATTERN:
            some, query = _walk(value[-1])
        elif kind is op.BRANCH:
            parts = [_walk(p) for p in value[1]]
            some = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            query = _join("or", [_of_strings(s) if s is not None else q for s, q in parts])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            strings, inside = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                some = {""} | strings
            elif low == high and strings is not None and len(strings) ** low <= EXACT:
                some = {""}
                for _ in range(low):
                    some = {a + b for a in some for b in strings}
            elif low:
                query = inside if strings is None else _of_strings(strings)
        if some is not None and len(exact) * len(some) <= EXACT:
            exact = {a + b for a in exact for b in some}
            continue
        whole = False
        flush(exact)
        queries.append(query)
        exact = some if some is not None and len(some) <= EXACT else {""}
    if whole:
        return exact, _of_strings(exact)
    flush(exact)
    return None, _join("and", queries)


def trigram_query(pattern: str) -> object:
    """A Boolean query over lower-case trigrams that every text with a match fulfils; True where none is mandatory."""
    return _walk(parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Scanner:
    """The rules with their queries, and the table of trigrams that the queries ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.slots = np.zeros(1 << 24, np.uint8 if len(self.trigrams) < 255 else np.uint16)
        for slot, trigram in enumerate(self.trigrams, 1):
            a, b, c = trigram.encode("latin-1")
            self.slots[a << 16 | b << 8 | c] = slot
        self.number = {t: i for i, t in enumerate(self.trigrams, 1)}

    def postings(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Inverted index of a block: for each trigram that a rule asks for, the sorted numbers of its texts."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes = np.frombuffer(b"\0".join(texts).translate(_LOWER), np.uint8).astype(np.uint32)
        if len(codes) < 3:
            return {}
        trigrams = codes[:-2] << np.uint32(16)
        trigrams |= codes[1:-1] << np.uint32(8)
        trigrams |= codes[2:]
        found = self.slots[trigrams]
        places = np.flatnonzero(found)
        pairs = found[places].astype(np.int64) * len(texts) + np.searchsorted(ends, places, side="right")
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        slots, numbers = np.divmod(pairs, len(texts))
        cuts = np.flatnonzero(np.diff(slots)) + 1
        return dict(zip(slots[np.r_[0, cuts]].tolist(), np.split(numbers, cuts), strict=True)) if len(slots) else {}

    def candidates(self, query: object, index: dict[int, np.ndarray], size: int) -> np.ndarray:
        """Numbers of the texts that fulfil the query: postings intersected and united."""
        if query is True:
            return np.arange(size)
        if isinstance(query, str):
            return index.get(self.number[query], np.empty(0, np.int64))
        parts = [self.candidates(q, index, size) for q in query[1]]
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out

    def block(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text of a block, by start, then in the order of the rules."""
        index = self.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for rule, pattern, query in self.rules:
            for number in self.candidates(query, index, len(texts)).tolist():
                out[number] += [(rule.kind, *span) for span in rule.spans(pattern, texts[number])]
        for spans in out:
            spans.sort(key=lambda s: s[1])  # stable: kinds stay in the order of the rules
        return out

    def scan(self, texts: list[str | None]) -> Iterator[list[tuple[str, int, int]]]:
        block, size = [], 0
        for text in texts:
            if block and (len(block) >= BLOCK_TEXTS or size + len(text or "") > BLOCK_BYTES):
                yield from self.block(block)
                block, size = [], 0
            block.append(text or "")
            size += len(text or "")
        if block:
            yield from self.block(block)


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans (kind, start, end in code points, end exclusive) of the secrets in a text, by start, then by rule order.

    The texts of a block are indexed once: trigram to the numbers of the texts that hold it, for the trigrams that
    the rules' queries name. Each rule's query picks candidates from the postings, and the rule itself verifies
    them over the whole text; rules without a mandatory trigram go over all texts. NULL and empty texts have no
    spans. Nothing is shuffled: blocks are runs of rows of a task.
    """

    def scan(texts: pa.Array) -> pa.Array:
        rows = [
            [{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in _scanner(rules).scan(texts.to_pylist())
        ]
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(rows, pa.list_(span))

    return F.arrow_udf(scan, SPANS)(text)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, spans) of ``docs`` (doc_id, text); repeated and NULL ids give their own rows, other columns go."""
    return docs.select("doc_id", secret_spans(F.col("text"), rules).alias("spans"))


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each run of overlapping secrets replaced by ``<secret>``; NULL where there is nothing to replace."""

    def cut(texts: pa.Array) -> pa.Array:
        values, out = texts.to_pylist(), []
        for value, places in zip(values, _scanner(rules).scan(values), strict=True):
            parts, at = [], 0
            for _, start, end in places:
                if start >= at or not parts:
                    parts += [value[at:start], "<secret>"]
                at = max(at, end)
            out.append("".join([*parts, value[at:]]) if parts else None)
        release_memory()
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(text)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; all rows and columns stay, ``n_chars`` follows where there is one."""
    out = docs.withColumn("_redacted", redacted(F.col("text"), rules))
    out = out.withColumn("text", F.coalesce("_redacted", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
