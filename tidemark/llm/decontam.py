"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

One pass over the tokens counts the benchmark's terms, a second one stores the postings of the rarest of them: term,
document, position. For each window the lists of its two rarest terms are intersected after their offsets are taken off,
and what remains is compared word by word. The same postings give the places where an item's two rarest terms stand near
each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What separates words once A-Z are lower-cased: ASCII other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def phrases(benchmark: DataFrame, length: int) -> DataFrame:
    """Distinct windows: phrase, words, n, items (ids of the items that have it)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - length + 1))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items")).select(
        F.array_join("words", " ").alias("phrase"), "words", F.size("words").alias("n"), "items"
    )


def tokens(docs: DataFrame) -> DataFrame:
    """row, doc_id, words, n_words; stored, as several steps read it.

    The index knows texts by their row, as a doc_id may be null or stand for several rows.
    """
    made = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("words"))
    return common.stored(made.withColumn("n_words", F.size("words").cast("bigint")), "tokens")


def postings(tokenised: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms: term, row, pos (from 0)."""
    every = tokenised.select("row", F.posexplode("words").alias("pos", "term"))
    return every.join(common.small(terms), "term").select("term", "row", "pos")


def anchored(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with their two rarest terms and offsets (t1, o1, t2, o2)."""
    each = windows.select("phrase", F.posexplode("words").alias("o", "term")).join(common.small(frequency), "term", "left")
    ranked = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "o", "term"))).alias("r"))
    ranked = ranked.filter(F.col("r")[0]["df"] > 0).withColumn("second", F.get("r", F.lit(1)))
    return ranked.select(
        "phrase", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["o"].alias("o1"), F.coalesce("second.term", F.col("r")[0]["term"]).alias("t2"), F.coalesce("second.o", F.col("r")[0]["o"]).alias("o2")
    )


def bags(benchmark: DataFrame) -> DataFrame:
    """Items of two or more distinct words: item_id, words, phrase (the words joined)."""
    items = benchmark.select("item_id", F.array_distinct(words_of(F.col("text"))).alias("words")).filter("size(words) > 1")
    return items.withColumn("phrase", F.array_join("words", " "))


def rarest_pairs(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """The two rarest terms of each bag that are in some document: phrase, t1, t2. Terms in none are left aside; bags with fewer than two others have no pair."""
    each = items.select("phrase", "words").distinct().select("phrase", F.posexplode("words").alias("o", "term")).join(common.small(frequency), "term")
    ranked = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("df", "o", "term"))).alias("r")).filter("size(r) > 1")
    return ranked.select("phrase", F.col("r")[0]["term"].alias("t1"), F.col("r")[1]["term"].alias("t2"))


def exact_matches(tokenised: DataFrame, anchors: DataFrame, index: DataFrame) -> DataFrame:
    """Occurrences of windows: the rows of ``tokenised`` with hits, an array of (start, n, items), without words."""
    first = index.withColumnRenamed("term", "t1").join(common.small(anchors), "t1").withColumn("start", F.col("pos") - F.col("o1")).filter("start >= 0")
    second = index.select(F.col("term").alias("t2"), "row", F.col("pos").alias("at"))
    both = first.withColumn("at", F.col("start") + F.col("o2")).join(second, ["row", "t2", "at"], "left_semi")
    places = common.stored(both.groupBy("row").agg(F.collect_set(F.struct("start", "n", "phrase", "items")).alias("places")), "places")
    # Words of documents with candidates only are moved; the others' rows have no words by then.
    rows = tokenised.join(common.small(places.select("row"), 1_000_000), "row", "left_semi").join(places, "row")
    same = lambda p: F.array_join(F.slice("words", p["start"] + 1, p["n"]), " ") == p["phrase"]
    hits = F.transform(F.filter("places", same), lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["items"].alias("items")))
    found = common.stored(rows.select("row", hits.alias("hits")), "hits")
    out = tokenised.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)))


def near_matches(items: DataFrame, pairs: DataFrame, index: DataFrame, within: int) -> DataFrame:
    """Documents in which the two rarest terms of a bag stand at most ``within`` words apart: item_id, row, nearest."""
    # Positions are dealt to blocks of ``within`` words: near ones are in the same or a neighbouring block.
    one = index.select(F.col("term").alias("t1"), "row", "pos").join(common.small(pairs.select("t1", "t2").distinct()), "t1")
    one = one.withColumn("block", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("pos") / within) + d)))
    two = index.select(F.col("term").alias("t2"), "row", F.col("pos").alias("other")).withColumn("block", F.floor(F.col("other") / within))
    gap = F.abs(F.col("pos") - F.col("other"))
    near = one.join(two, ["row", "t2", "block"]).filter(gap <= within).groupBy("t1", "t2", "row").agg(F.min(gap).cast("int").alias("nearest"))
    of = items.select("item_id", "phrase").join(pairs, "phrase").select("item_id", "t1", "t2").distinct()
    return near.join(common.small(of), ["t1", "t2"]).groupBy("item_id", "row").agg(F.min("nearest").alias("nearest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, within: int = 20) -> DataFrame:
    """Which words of each document lie in benchmark windows, and which items it comes near to.

    In: documents (doc_id, text), benchmark (item_id, text). Out, a row for each document: doc_id, n_words, n_hit (words
    inside an occurrence of a window), n_items, items_sha256 (of the sorted ids as text, joined by commas),
    contaminated (n_hit > 0), n_near (items of which the two rarest terms that occur at all stand at most ``within`` words
    apart) and nearest, the smallest such distance (null without one). Nearness doesn't make a document contaminated.

    A window is ``length`` words of an item, or all of a shorter one; null has no words. Each row has the matches of its own
    text, also without a doc_id or where several rows share one. Items without an id count with an empty id, and as one item
    that is near. Other columns are ignored; an empty table gives no rows, and without items nothing is hit.
    """
    tokenised = tokens(docs)
    windows, items = common.stored(phrases(benchmark, length), "phrases"), common.stored(bags(benchmark), "bags")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    frequency = common.stored(postings(tokenised, terms).groupBy("term").agg(F.count("*").alias("df")), "frequency")
    anchors = common.stored(anchored(windows, frequency).join(windows, "phrase"), "anchors")
    pairs = common.stored(rarest_pairs(items, frequency), "pairs")
    rare = anchors.select(F.explode(F.array("t1", "t2")).alias("term")).union(pairs.select(F.explode(F.array("t1", "t2")).alias("term"))).distinct()
    index = common.stored(postings(tokenised, rare), "postings")
    near = near_matches(items, pairs, index, within).groupBy("row").agg(F.count("*").alias("n_near"), F.min("nearest").alias("nearest"))
    exact = _counted(exact_matches(tokenised, anchors, index))
    return exact.join(common.stored(near, "near"), "row", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint"))).drop("row")


def _counted(found: DataFrame) -> DataFrame:
    """What the hits of each document come to."""
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return found.select(
        "row", "doc_id", "n_words", covered.cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )
