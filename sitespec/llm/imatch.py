"""I-Match fingerprints: hashes of a text's terms within a band of document frequencies, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import materialize
from sitespec.operators.ranking import number_within

#: Terms are kept whose log2(documents / documents with the term) lies between these.
LEAST_IDF, MOST_IDF = 1.0, 9.0
#: Randomised lexicons: so many that hold each term with a chance of one in 16, 64, 256 and 1,024.
SUBSETS = ((8, 16), (8, 64), (8, 256), (8, 1024))
WIDTHS = [width for count, width in SUBSETS for _ in range(count)]
#: Lexicons up to this many rows are broadcast (24 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
KEY = ["key_id", "key_text"]
#: Stands for a missing doc_id.
NO_ID = -(2**63)


def terms(text: Column) -> Column:
    """Distinct terms of a text: runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(texts: DataFrame, least: float = LEAST_IDF, most: float = MOST_IDF) -> DataFrame:
    """(term, subset): the 64-bit hash of each term of the band, once for each randomised lexicon that holds it.

    Frequencies are counted over all rows of ``texts`` (text). A term of the band is in at least one of ``2**most``
    documents, so there are at most ``2**most`` times as many terms as a document has on average, however many
    documents there are.
    """
    words = texts.select(F.explode(terms(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = texts.count()
    held = counts.filter((F.col("n") >= n * 2.0**-most) & (F.col("n") <= n * 2.0**-least))
    widths = F.array(*(F.lit(w) for w in WIDTHS))
    inside = F.filter(
        F.sequence(F.lit(0), F.lit(len(WIDTHS) - 1)), lambda s: F.pmod(F.xxhash64("term", s), F.get(widths, s)) == 0
    )
    return held.select("term", F.explode(inside).alias("subset"))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (key_id, key_text, text): NULL texts are empty; rows of one id are told apart by text.

    These columns and no others, so that the one shuffle of the texts serves every place that needs them.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key_id"), F.xxhash64("text").alias("key_text"), "text")


def n_chars() -> Column:
    """Code points of the text."""
    return F.char_length("text").cast("long")


def neighbours(docs: DataFrame) -> DataFrame:
    """For each distinct key its number of characters and the key of the next one, the first after the last.

    The order is that of a range sort over narrow rows: no window gathers them in one task.
    """
    narrow = keyed(docs).select(*KEY, n_chars().alias("n_chars")).distinct().withColumn("_all", F.lit(0))
    ranked = materialize(number_within(narrow, ["_all"], KEY, "rank", "_n").drop("_all"), "ranks")
    following = ranked.select(F.col("key_id").alias("next_id"), F.col("key_text").alias("next_text"), "rank")
    follows = F.when(F.col("rank") == F.col("_n"), F.lit(1)).otherwise(F.col("rank") + 1)
    return materialize(ranked.withColumn("rank", follows).join(following, "rank").drop("rank", "_n"), "neighbours")


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """Each row with its edited text: its last quarter replaced by the beginning of the next document.

    The last floor(n_chars / 4) code points give way to as many first ones of the next (or all it has). Texts are
    shuffled once, by their key; beside them only the beginnings travel.
    """
    rows = keyed(docs)
    wanted = order.select(
        F.col("next_id").alias("key_id"), F.col("next_text").alias("key_text"), F.col("key_id").alias("to_id"),
        F.col("key_text").alias("to_text"), F.floor(F.col("n_chars") / 4).cast("int").alias("need"),
    )
    pieces = rows.join(wanted, KEY).select(
        F.col("to_id").alias("key_id"), F.col("to_text").alias("key_text"), F.substring("text", F.lit(1), F.col("need")).alias("piece")
    )
    pieces = pieces.dropDuplicates(KEY)
    stays = F.substring("text", F.lit(1), (n_chars() - F.floor(n_chars() / 4)).cast("int"))
    return rows.join(pieces, KEY).withColumn("edited", F.concat(stays, "piece")).drop("piece")


def hashed(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """(key_id, key_text, hashes): by version * subsets + subset, the hash of the sorted distinct terms it keeps.

    ``texts`` has ``versions``, an array of texts, and is partitioned by its key already: terms are looked up and
    gathered without another shuffle where the lexicon is broadcast.
    """
    rows = texts.select(*KEY, F.posexplode("versions").alias("version", "text"))
    rows = rows.select(*KEY, "version", F.explode(terms(F.col("text"))).alias("word"))
    rows = rows.select(*KEY, "version", F.xxhash64("word").alias("term")).join(kept, "term")
    slot = (F.col("version") * len(WIDTHS) + F.col("subset")).alias("slot")
    sets = rows.select(*KEY, slot, "term").groupBy(*KEY, "slot").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    prints = sets.select(*KEY, F.struct("slot", F.xxhash64("terms").alias("hash")).alias("entry"))
    return prints.groupBy(*KEY).agg(F.map_from_entries(F.collect_list("entry")).alias("hashes"))


def _print(version: int, stand_in: Column) -> Column:
    """Hashes of the subsets, as hex, empty where a subset keeps no term; without any, the text's own hash."""
    first = version * len(WIDTHS)
    parts = F.transform(F.sequence(F.lit(first), F.lit(first + len(WIDTHS) - 1)), lambda s: F.coalesce(F.lpad(F.lower(F.hex(F.element_at("hashes", s))), 16, "0"), F.lit("")))
    some = F.exists(parts, lambda x: x != "")
    return F.when(F.coalesce(some, F.lit(False)), F.array_join(parts, "-")).otherwise(F.concat(F.lit("text:"), F.lower(F.hex(stand_in))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets that keep terms of either text in which the kept terms are the same; 1 for equal fingerprints."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    some = F.filter(pairs, lambda p: (F.coalesce(p["a"], F.lit("")) != "") | (F.coalesce(p["b"], F.lit("")) != ""))
    same = F.filter(some, lambda p: p["a"] == p["b"])
    return F.when(a == b, 1.0).otherwise(F.size(same) / F.greatest(F.size(some), F.lit(1)))


def fingerprints(docs: DataFrame, least: float = LEAST_IDF, most: float = MOST_IDF) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of ``docs`` (doc_id, text).

    The fingerprint holds, for each randomised lexicon, the hash of the text's sorted distinct terms in it. Equal
    texts have equal fingerprints; a changed text keeps those of the lexicons that hold none of the changed terms.
    NULL texts are empty. The order of documents is by doc_id, rows without one first, rows with equal ids by
    their texts' hashes; exact repetitions count once in the order and give a row each. One document is its own
    next. An empty table gives no rows. Other columns are not looked at.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    kept = materialize(lexicon(texts, least, most), "lexicon")
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    order = neighbours(docs)
    both = edited_texts(docs, order)
    prints = hashed(both.select(*KEY, F.array("text", "edited").alias("versions")), kept)
    doc_id = F.nullif(F.col("key_id"), F.lit(NO_ID)).alias("doc_id")
    facts = both.select(*KEY, doc_id, n_chars().alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("_edited"))
    made = facts.join(prints, KEY, "left").select(
        *KEY, "doc_id", "n_chars", "edited_sha256", _print(0, F.col("key_text")).alias("fingerprint"), _print(1, F.col("_edited")).alias("edited_fingerprint")
    )
    made = materialize(made, "prints")
    after = made.select(F.col("key_id").alias("next_id"), F.col("key_text").alias("next_text"), F.col("fingerprint").alias("_next")).dropDuplicates(["next_id", "next_text"])
    after = order.select(*KEY, "next_id", "next_text").join(after, ["next_id", "next_text"]).select(*KEY, "_next")
    return made.join(after, KEY).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
