"""Cluster names from word counts.

Words are counted per cluster with a hash aggregate that also keeps the first document of a word. Ties
go to the word seen first; the place inside that document is looked up for the few words it decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersheaf.functions import lexicon, names, ranking, text
from papersheaf.session import materialized

Lexicon = dict[str, "list[str] | str"]


def _counted(rows: DataFrame, words: Column, usable: Column) -> DataFrame:
    """``(cluster_id, word, n, first_doc)`` from an array of words per document."""
    exploded = rows.select("cluster_id", "doc_id", F.explode(words).alias("word"))
    return (
        exploded.filter(usable)
        .groupBy("cluster_id", "word")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    )


def _top(rows: DataFrame, words: Column, counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words of each cluster, ties by first document, then by place in it.

    Words that tie on both count and first document all come from that one document, so what is kept
    beyond ``k`` is bounded by its length.
    """
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), F.asc("first_doc"))
    tied = counts.withColumn("_r", F.rank().over(order)).filter(F.col("_r") <= k).drop("_r")
    few = tied.select(F.col("first_doc").alias("doc_id")).distinct()  # at most k documents and ties per cluster
    place = rows.join(few, "doc_id", "left_semi").select(F.col("doc_id").alias("first_doc"), words.alias("_words"))
    located = tied.join(place, "first_doc").withColumn("place", F.array_position("_words", F.col("word")))
    return ranking.top_per_key(
        located.drop("_words"), ["cluster_id"], [F.desc("n"), F.asc("first_doc"), F.asc("place")], k
    )


def _content_words(text_field: str) -> tuple[Column, Column]:
    return text.lowercase_words(F.col(text_field), 4), ~F.col("word").isin(lexicon.STOP_WORDS)


def word_counts(documents: DataFrame, text_field: str = "full_text") -> DataFrame:
    """Words of at least four letters a-z, without stop words, counted per cluster."""
    return _counted(documents, *_content_words(text_field))


def cluster_top_words(documents: DataFrame, k: int = 3, text_field: str = "full_text") -> DataFrame:
    """``(cluster_id, rank, word, n)`` for the most frequent words, ties by first appearance."""
    words, usable = _content_words(text_field)
    counts = materialized(_counted(documents, words, usable))
    return _top(documents, words, counts, k).select("cluster_id", "rank", "word", "n")


def domain_table(spark: SparkSession, domains: Lexicon | None = None) -> DataFrame:
    return spark.createDataFrame(lexicon.domain_rows(domains), "domain_rank int, domain string, word string")


def _domain_scores(counts: DataFrame, domains: Lexicon | None) -> DataFrame:
    table = domain_table(counts.sparkSession, domains)  # fixed size, or the caller's own word list
    return (
        counts.join(table, "word")
        .groupBy("cluster_id", "domain_rank", "domain")
        .agg(F.sum("n").alias("score"))
    )


def domain_scores(documents: DataFrame, domains: Lexicon | None = None, text_field: str = "full_text") -> DataFrame:
    """``(cluster_id, domain, score)`` for domains that occur."""
    return _domain_scores(word_counts(documents, text_field), domains).select("cluster_id", "domain", "score")


def content_names(documents: DataFrame, domains: Lexicon | None = None, text_field: str = "full_text") -> DataFrame:
    """``(cluster_id, name)``: best domain, else the top words joined, else ``Topic_id``; then the size."""
    counts = materialized(word_counts(documents, text_field))  # texts are split once for both uses
    best = ranking.top_per_key(
        _domain_scores(counts, domains), ["cluster_id"], [F.desc("score"), F.asc("domain_rank")], 1
    ).select("cluster_id", "domain")
    frequent = (
        _top(documents, _content_words(text_field)[0], counts.filter("n >= 2"), 3)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"))  # three at most
        .select(
            "cluster_id",
            F.array_join(F.transform(F.slice("top", 1, 2), lambda w: F.initcap(w.word)), "_").alias("words"),
        )
    )
    sizes = documents.groupBy("cluster_id").agg(F.count("*").alias("size"))
    name = F.coalesce("domain", "words", F.concat(F.lit("Topic_"), F.col("cluster_id").cast("string")))
    return (
        sizes.join(best, "cluster_id", "left")
        .join(frequent, "cluster_id", "left")
        .select("cluster_id", F.format_string("%s_(%ddocs)", name, "size").alias("name"))
    )


def _filename_words() -> Column:
    spaced = F.translate(names.stem(F.col("document_name")), "_-", "  ")
    parts = F.split(text.strip(spaced), f"{text.SPACE}+")
    return F.transform(F.filter(parts, lambda p: ~p.rlike(r"^\p{Nd}+$")), F.lower)


def filename_keywords(assignments: DataFrame, k: int = 3) -> DataFrame:
    """``(cluster_id, rank, word, n)``: of the top words of file names, those seen more than once."""
    words = _filename_words()
    usable = (F.length("word") > 2) & ~F.col("word").isin(lexicon.FILENAME_STOP_WORDS)
    counts = _counted(assignments, words, usable).filter("n > 1")
    return _top(assignments, words, counts, k).select("cluster_id", "rank", "word", "n")


def filename_names(assignments: DataFrame) -> DataFrame:
    """``(cluster_id, name)``: top keyword, else ``group_id``, with the number of files."""
    first = filename_keywords(assignments, 1).select("cluster_id", "word")
    sizes = assignments.groupBy("cluster_id").agg(F.count("*").alias("size"))
    label = F.coalesce("word", F.concat(F.lit("group_"), F.col("cluster_id").cast("string")))
    return sizes.join(first, "cluster_id", "left").select(
        "cluster_id", names.sanitize_name(F.format_string("%s_%dfiles", label, "size")).alias("name")
    )


def theme_names(documents: DataFrame, text_field: str = "full_text") -> DataFrame:
    """``(cluster_id, name)`` by rules over the top three longer words, else the top word titled."""
    words = text.words(F.lower(text_field))
    usable = (F.length("word") > 4) & ~F.col("word").isin(lexicon.THEME_STOP_WORDS)
    frequent = (
        _top(documents, words, materialized(_counted(documents, words, usable).filter("n > 1")), 3)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"))  # three at most
        .select("cluster_id", F.col("top.word").alias("words"))
    )
    theme = F.lit(None).cast("string")
    for name, keywords in reversed(lexicon.THEMES):
        listed = F.array(*[F.lit(word) for word in keywords])
        theme = F.when(F.arrays_overlap("words", listed), name).otherwise(theme)
    titled = F.regexp_replace(F.initcap(F.regexp_replace(F.col("words")[0], r"([^\p{L}]+)", " $1 ")), " ", "")
    mixed = F.concat(F.lit("Mixed_Documents_"), F.col("cluster_id").cast("string"))
    return (
        documents.select("cluster_id")
        .distinct()
        .join(frequent, "cluster_id", "left")
        .select("cluster_id", F.coalesce(theme, titled, mixed).alias("name"))
    )
