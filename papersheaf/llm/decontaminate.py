"""Benchmark decontamination by a distributed positional inverted index.

Training texts are tokenised once and their postings (term, document, position) are written for all terms that the test
items use. A phrase is found by intersecting offset-adjusted lists, beginning with the rarest of its terms by posting count:
every posting of a term at offset ``o`` proposes the start ``position - o``, and a start that all of the few rarest lists propose
is then confirmed by the lists of all other terms at their positions. All of it is DataFrame work.

Phrases are windows of consecutive item words; neighbouring windows of an item lie on the same alignment of item and document,
so an alignment is confirmed once, with one row per item word, and windows are runs of confirmed words. Rows are spread by
(document, position), so neither a frequent term nor a passage that a third of the documents hold meets in one task.

Documents are known by ``doc_id`` and a checksum of the text, so rows that repeat an id do not mix. Defined results: null or empty
text has no words; items without words match nothing; an ``item_id`` of null is no item, and items of the same id are told
apart by their text but reported once. An empty benchmark contaminates nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersheaf.llm.tables import measured
from papersheaf.session import materialized

WIDTH = 13
RAREST = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "mark"]
NO_ID = -(2**63)  # stands for a missing id in the index


def terms(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), lambda word: word != "")


def marked(documents: DataFrame) -> DataFrame:
    """``(doc_id, mark, text)``; id and mark name a text."""
    known = F.coalesce("doc_id", F.lit(NO_ID))
    return documents.select(known.alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, n, words)``: distinct items with at least one word."""
    found = items.filter("item_id is not null").select("item_id", terms(F.col("text")).alias("words"))
    found = found.filter(F.size("words") > 0).distinct()
    return found.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("n"), "words")


def vocabulary(items: DataFrame) -> DataFrame:
    """``(term, term_id)`` for every word of ``item_terms``; the empty word stands for a document's end."""
    words = items.select(F.explode("words").alias("term")).distinct()
    return words.unionByName(words.sparkSession.createDataFrame([("",)], "term string")).select(
        "term", F.when(F.col("term") == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64("term")).alias("term_id")
    )


def postings(documents: DataFrame, known: DataFrame, average_bytes: int = 64) -> DataFrame:
    """The positional index ``(term_id, doc_id, mark, position)`` for the terms of ``known``, a written ``vocabulary``.

    Each document also has one posting of term 0, at the position after its last word: its length.
    """
    words = F.concat(terms(F.col("text")), F.array(F.lit("")))
    every = marked(documents).select(*KEY, F.posexplode(words).alias("position", "term"))
    return every.join(measured(known, average_bytes), "term").select("term_id", *KEY, "position")


def places(items: DataFrame) -> DataFrame:
    """``(item, item_id, n, offset, term_id)``, one row per word of an item."""
    return items.select("item", "item_id", "n", F.posexplode("words").alias("offset", "term")).select(
        "item", "item_id", "n", "offset", F.xxhash64("term").alias("term_id")
    )


def rarest(items: DataFrame, counts: DataFrame, width: int = WIDTH, rarest_terms: int = RAREST) -> DataFrame:
    """``(item, window, offset, term_id, rank, lists)``: for each window the words whose lists are read first.

    ``rank`` counts them from 0 and ``lists`` is their number, fewer than ``rarest_terms`` for short items. Windows with a term that no document has are left out.
    """
    word = places(items)
    first = F.greatest(F.col("offset") - (width - 1), F.lit(0))
    last = F.least("offset", F.greatest(F.col("n") - width, F.lit(0)))
    inside = word.withColumn("window", F.explode(F.sequence(first, last)))
    window = Window.partitionBy("item", "window")
    ranked = inside.join(counts, "term_id", "left").withColumn("known", F.count("postings").over(window) == F.count("*").over(window))
    order = F.row_number().over(window.orderBy("postings", "offset"))
    ranked = ranked.filter("known").withColumn("rank", order - 1).filter(F.col("rank") < rarest_terms)
    return ranked.select("item", "window", "offset", "term_id", "rank", F.least("n", F.lit(width), F.lit(rarest_terms)).alias("lists"))


def alignments(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(item, doc_id, mark, start)``: where an item would start in a document for some window that its rarest lists propose."""
    proposed = index.join(measured(chosen, 48), "term_id").select(
        "item", "window", "lists", "rank", *KEY, (F.col("position") - F.col("offset")).alias("start")
    )
    # a bit for each list, so that rows of the same document do not count twice
    lists = F.bit_or(F.expr("shiftleft(1, rank)"))
    agreed = proposed.groupBy("item", "window", "lists", *KEY, "start").agg(lists.alias("seen"))
    return agreed.filter("seen = shiftleft(1, lists) - 1").select("item", *KEY, "start").distinct()


def _searched(index: DataFrame, found: DataFrame) -> DataFrame:
    """The part of the index that belongs to documents of ``found``."""
    return index.join(measured(materialized(found.select(*KEY).distinct()), 32), KEY, "left_semi")


def phrase_matches(index: DataFrame, items: DataFrame, width: int = WIDTH, rarest_terms: int = RAREST) -> DataFrame:
    """``(item, item_id, doc_id, mark, position, length)``: every run of at least a window of item words in a document.

    ``index`` and ``items`` are written tables of ``postings`` and ``item_terms``.
    """
    counts = index.groupBy("term_id").agg(F.count("*").alias("postings"))
    chosen = materialized(rarest(items, counts, width, rarest_terms))
    found = materialized(alignments(index, chosen))
    word = measured(materialized(places(items)), 48)
    asked = found.join(word, "item").withColumn("position", F.col("start") + F.col("offset")).filter("position >= 0")
    hit = asked.join(_searched(index, found), [*KEY, "position", "term_id"])
    # words of one alignment in a row without a gap: offset less its rank is the same
    alignment = ["item", "item_id", "n", *KEY, "start"]
    rank = F.dense_rank().over(Window.partitionBy(*alignment).orderBy("offset"))
    runs = hit.withColumn("run", F.col("offset") - rank).groupBy(*alignment, "run")
    runs = runs.agg(F.min("position").alias("position"), (F.max("offset") - F.min("offset") + 1).alias("length"))
    return runs.filter(F.col("length") >= F.least("n", F.lit(width))).select("item", "item_id", *KEY, "position", "length")


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, width: int = WIDTH) -> DataFrame:
    """``(item, item_id, window, doc_id, mark, position)``: windows whose words all occur within ``slop`` of their place.

    ``position`` is where the window's rarest word stands; the others may each be shifted by up to ``slop`` words against it.
    """
    counts = index.groupBy("term_id").agg(F.count("*").alias("postings"))
    first = materialized(rarest(items, counts, width, 1))
    anchors = materialized(index.join(measured(first, 48), "term_id")).select(
        "item", "window", *KEY, F.col("position").alias("anchor"), (F.col("position") - F.col("offset")).alias("start")
    )
    word = materialized(places(items))
    span = F.sequence(F.lit(-slop), F.lit(slop))
    last = F.col("window") + F.least("n", F.lit(width)) - 1
    asked = anchors.join(measured(word, 48), "item").filter((F.col("offset") >= F.col("window")) & (F.col("offset") <= last))
    asked = asked.withColumn("position", F.explode(F.transform(span, lambda d: F.col("start") + F.col("offset") + d)))
    hit = asked.join(_searched(index, anchors), [*KEY, "position", "term_id"])
    whole = hit.groupBy("item", "item_id", "n", "window", *KEY, "anchor").agg(F.count_distinct("offset").alias("found"))
    whole = whole.filter(F.col("found") == F.least("n", F.lit(width)))
    return whole.select("item", "item_id", "window", *KEY, F.col("anchor").alias("position"))


def contamination(documents: DataFrame, items: DataFrame, width: int = WIDTH, rarest_terms: int = RAREST) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)``, one row per row of ``documents``.

    ``items`` are the ids of the items that share a window, sorted as text. A document is contaminated where at least a
    twentieth of its words lie in shared windows.
    """
    asked = materialized(item_terms(items))
    index = materialized(postings(documents, materialized(vocabulary(asked))))
    matches = materialized(phrase_matches(index, asked, width, rarest_terms))
    end = F.col("position") + F.col("length") - 1
    words = matches.select(*KEY, F.explode(F.sequence("position", end)).alias("position")).distinct()
    hits = words.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = matches.select(*KEY, F.col("item_id").cast("string").alias("name")).distinct()
    named = named.groupBy(*KEY).agg(F.array_sort(F.collect_list("name")).alias("items"))  # no more than the document's words
    lengths = index.filter("term_id = 0").select(*KEY, F.col("position").cast("bigint").alias("n_words"))
    return (
        lengths.join(hits.join(named, KEY), KEY, "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .select(
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            "items",
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )
