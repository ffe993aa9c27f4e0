"""URL filters: base rules of hosts and paths, and rules of URL tokens that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.schemas import materialize

ALLOW, BLOCK = "allow", "block"
#: Least share of the labelled URLs that hold a combination with its verdict, and least confidence of a mined rule.
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Most frequent tokens of a labelled URL for which FP-growth looks at all combinations, 2 ** TOKENS of a URL. Where a
#: URL holds more, all its tokens take part too, but level by level over the combinations that can make a rule.
TOKENS = 10
#: Marks the verdict within the items of a labelled URL; no URL token starts so.
_MARK = "="

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*+)([^?#]*+)(?:\?([^#]*+))?"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The base rules.
BASE = (
    UrlRule("com", "/", ALLOW),
    UrlRule("example.com", "/en/", BLOCK),
    UrlRule("www.example.com", "/en/", ALLOW),
    UrlRule("net", "/es/", BLOCK),
    UrlRule("net", "/fr/", BLOCK),
)


@dataclass(frozen=True)
class TokenRule:
    """URLs that hold all ``tokens`` had the verdict with this confidence among the labelled ones."""

    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float

    @property
    def text(self) -> str:
        return " ".join(sorted(self.tokens))

    @property
    def rank(self) -> tuple:
        """The first rule by this order decides: the surest, then the best supported, the longest, blocks first."""
        return -self.confidence, -self.support, -len(self.tokens), self.verdict != BLOCK, self.text


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = BASE) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; NULL where none does. ``rules`` is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the last ``when`` is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, segments of the path (numbers as one), its ending, query keys."""
    host, path = url_host(url), url_path(url)
    query = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind + ":"), p))

    segments = F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, r"^[0-9]++(?:\.[A-Za-z0-9]++)?$", "0"))
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]++)$", 1))
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(
        F.concat(named("host", F.split(host, r"\.")), named("path", segments), named("ending", ending), named("key", keys))
    )


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[TokenRule]:
    """Rules token combination to verdict from ``labelled`` (tokens array<string>, verdict), all rows of it.

    FP-growth runs on the cluster over all labelled URLs, with all their frequent tokens; ``_long_rules`` does where
    one holds more than ``TOKENS`` of these. The pruned rules come to the driver. A rule goes where its confidence or
    support is too low, where it is no likelier than the verdict is anyway, or where a rule with one token less says
    the same as surely.
    """
    total = labelled.count()
    if not total:
        return []
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    common = counts.filter(F.col("n") >= support * total).orderBy(F.desc("n"), "token").collect()  # tokens of a URL / support
    order = F.array(*(F.lit(r.token) for r in common)) if common else F.array().cast("array<string>")
    frequent = F.array_intersect(order, F.col("tokens"))
    if labelled.agg(F.max(F.size(frequent))).first()[0] > TOKENS:
        rules = _long_rules(labelled.select(frequent.alias("items"), "verdict"), total, support, confidence)
    else:
        items = F.concat(frequent, F.array(F.concat(F.lit(_MARK), "verdict")))
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(items.alias("items")))
        sure = model.associationRules.filter(F.col("consequent")[0].startswith(_MARK) & (F.col("lift") > 1))
        rules = {
            (frozenset(r.antecedent), r.consequent[0][len(_MARK) :]): (r.confidence, r.support)
            for r in sure.select("antecedent", "consequent", "confidence", "support").collect()
        }
    out = []
    for (tokens, verdict), (sureness, share) in rules.items():
        shorter = (rules.get((tokens - {t}, verdict)) for t in tokens)
        if not any(s and s[0] >= sureness for s in shorter):
            out.append(TokenRule(tokens, verdict, sureness, share))
    return sorted(out, key=lambda r: r.rank)


def _long_rules(labelled: DataFrame, total: int, support: float, confidence: float) -> dict[tuple, tuple[float, float]]:
    """(tokens, verdict) to (confidence, support) as from FP-growth, without those that ``mine_rules`` prunes anyway.

    ``labelled`` has the frequent ``items`` of each URL, in one order, and its verdict. Combinations grow by a token a
    level, counted over the distinct rows that hold them. One is left, with all that hold it, where no verdict is
    frequent with it, where one is certain, or where a token less is held by as many URLs: what follows has the
    verdict of a shorter rule as surely. So tokens that come together, however many, don't multiply.
    """
    least = math.ceil(support * total)
    whole = {r.verdict: r.n for r in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = materialize(labelled.groupBy("items", "verdict").agg(F.count(F.lit(1)).alias("n")), "labelled")
    held = rows.select("*", F.explode("items").alias("t")).withColumn("set", F.array("t")).drop("t")
    alive, rules, size = None, {}, 1
    while True:
        by_verdict = held.groupBy("set", "verdict").agg(F.sum("n").alias("hits"))
        hits = F.collect_list(F.struct("verdict", "hits"))
        counts = by_verdict.groupBy("set").agg(F.sum("hits").alias("n"), F.max("hits").alias("most"), hits.alias("by"))
        if alive is None:
            counts = counts.filter(F.col("n") < total)
        else:  # all combinations with a token less are alive and held by more URLs
            less = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(
                F.slice("set", F.lit(1), i - 1), F.slice("set", i + 1, F.lit(size))))
            shorter = counts.select("set", F.explode(less).alias("less")).join(
                alive.select(F.col("set").alias("less"), F.col("n").alias("around")), "less")
            fewest = shorter.groupBy("set").agg(F.count(F.lit(1)).alias("subsets"), F.min("around").alias("around"))
            counts = counts.join(fewest, "set").filter((F.col("subsets") == size) & (F.col("n") < F.col("around")))
        counts = materialize(counts.filter(F.col("most") >= least).select("set", "n", "most", "by"), "combinations")
        sure = counts.select("set", "n", F.explode("by").alias("v")).select("set", "n", "v.*")
        for r in sure.filter((F.col("hits") >= least) & (F.col("hits") >= confidence * F.col("n"))).toLocalIterator():
            if r.hits * total > r.n * whole[r.verdict]:  # likelier than anyway
                rules[frozenset(r.set), r.verdict] = r.hits / r.n, r.hits / total
        alive = counts.filter(F.col("most") < F.col("n"))
        if alive.isEmpty():
            return rules
        later = F.slice("items", F.array_position("items", F.element_at("set", -1)).cast("int") + 1, F.size("items"))
        grown = held.join(alive.select("set"), "set").select("items", "verdict", "n", "set", F.explode(later).alias("t"))
        held = materialize(grown.select("items", "verdict", "n", F.array_append("set", F.col("t")).alias("set")), "held")
        size += 1


class RuleIndex:
    """Rules by their rarest token: a URL is asked only for rules whose rarest token it holds."""

    def __init__(self, rules: list[TokenRule]):
        self.rules = sorted(rules, key=lambda r: r.rank)
        uses: dict[str, int] = {}
        for rule in rules:
            for token in rule.tokens:
                uses[token] = uses.get(token, 0) + 1
        self.lists: dict[str, list[int]] = {}
        for number, rule in enumerate(self.rules):
            self.lists.setdefault(min(rule.tokens, key=lambda t: (uses[t], t)), []).append(number)

    def best(self, tokens: list[str] | None) -> TokenRule | None:
        """The first rule, by rank, all of whose tokens are there."""
        held = set(tokens or ())
        first = len(self.rules)
        for token in held:
            for number in self.lists.get(token, ()):
                if number >= first:
                    break
                if self.rules[number].tokens <= held:
                    first = number
        return self.rules[first] if first < len(self.rules) else None


def mined_verdict(tokens: Column, rules: list[TokenRule]) -> Column:
    """struct<tokens, verdict, confidence> of the mined rule that decides; NULL where none matches."""
    index = RuleIndex(rules)
    kind = pa.struct([("tokens", pa.string()), ("verdict", pa.string()), ("confidence", pa.float64())])

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = (index.best(row) for row in batch.to_pylist())
            yield pa.array(
                [r and {"tokens": r.text, "verdict": r.verdict, "confidence": r.confidence} for r in found], kind
            )

    return F.arrow_udf(judge, "struct<tokens:string,verdict:string,confidence:double>")(tokens)


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = BASE, labelled: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, mined_rule, confidence) of ``pages`` (page_id, url).

    The longest base rule that fits decides; a URL without one gets the verdict of the first mined rule that it
    matches, and is allowed where there is none. Rules are mined from ``labelled`` (url, verdict) or, where that is
    not given, from the URLs that base rules decide, with their verdicts. ``mined_rule`` and ``confidence`` are
    NULL where no mined rule decided. NULL and empty URLs and those without ``://`` have an empty host and path and
    no token; rows with repeated or NULL ids each get a row; URLs are read whole whatever their length; ties
    between rules follow ``TokenRule.rank``; an empty table gives no row, and other columns go.
    """
    url = F.col("url").cast("string")
    parts = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), url_tokens(url).alias("tokens"))
    parts = parts.withColumn("base", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = parts.filter("base IS NOT NULL").select("tokens", "base.verdict")
    else:
        known = labelled.filter("verdict IS NOT NULL").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    mined = mine_rules(known.filter(F.col("tokens").isNotNull()))
    open_ones = F.when(F.col("base").isNull(), F.col("tokens"))
    judged = parts.select("page_id", "host", "path", "base", mined_verdict(open_ones, mined).alias("mined"))
    verdict = F.coalesce("base.verdict", "mined.verdict", F.lit(ALLOW))
    return judged.select(
        "page_id", "host", "path", F.col("base.rule").alias("rule"), verdict.alias("verdict"),
        F.col("mined.tokens").alias("mined_rule"), F.col("mined.confidence").alias("confidence"),
    )
