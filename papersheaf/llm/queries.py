"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersheaf.llm import bpe, counts, decontaminate, exact, html, minhash, pii, quality, repair, substrings, toxicity, urls, whitening
from papersheaf.session import materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


ORACLES["op8_exact"] = r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM plain
"""


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(~quality.held_out())


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, training_labels(spark, sf_dir))
    scored = quality.score(documents, model)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, training_labels(spark, sf_dir))
    return toxicity.score(documents, model).withColumn("held_out", quality.held_out())


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# The list of hosts for the method: those of the corpus that carry one of these words in their name.
LISTED_WORDS = r"(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"


@query
def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    hosts = materialized(pages.select("host").distinct())
    cascades = urls.build(hosts.filter(F.col("host").rlike(LISTED_WORDS)), hosts, "host")
    judged = urls.contains(pages, F.col("host"), cascades)
    rule, verdict = urls.best_rule(F.col("host"), F.col("path"), URL_RULES)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


ORACLES["op1_urls"] = rf"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), named AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), fitted AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM named
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '{LISTED_WORDS}') THEN 'block' ELSE 'allow' END AS verdict
FROM fitted
"""


def tokenizer_source(path: str = public_tokenizers.path("byte_bpe_50k.json")) -> str:
    """The tokenizer file, read on the driver: it is installed there and goes to the tasks as a broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_source())
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


ORACLES["op4_decontaminate"] = rf"""
WITH word AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS k
        FROM (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'),
                                                '{decontaminate.NO_WORD}') AS words FROM documents))
  WHERE word <> ''
), item_word AS (
  SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS position
  FROM (SELECT item_id, unnest(words) AS word, unnest(range(len(words))) AS k
        FROM (SELECT item_id, string_split_regex(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'),
                                                 '{decontaminate.NO_WORD}') AS words FROM benchmark))
  WHERE word <> ''
), item_size AS (
  SELECT item_id, least(count(*), 13) AS width FROM item_word GROUP BY item_id
), item_window AS (
  SELECT DISTINCT a.item_id, width, phrase FROM (
    SELECT item_id, width, string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS phrase,
           count(*) OVER (PARTITION BY item_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS found
    FROM item_word JOIN item_size USING (item_id)) a
  WHERE found = width
), document_window AS (
  SELECT doc_id, position, w.width, array_to_string(list_slice(words, position + 1, position + w.width), ' ') AS phrase
  FROM word JOIN (SELECT doc_id, list(word ORDER BY position) AS words FROM word GROUP BY doc_id) USING (doc_id)
  CROSS JOIN (SELECT DISTINCT width FROM item_size) w
  WHERE position + w.width <= len(words)
), hit AS (
  SELECT doc_id, position, width, item_id FROM document_window JOIN item_window USING (width, phrase)
), hit_word AS (
  SELECT doc_id, count(DISTINCT position + k) AS n_hit
  FROM (SELECT doc_id, position, unnest(range(width)) AS k FROM hit) GROUP BY doc_id
), hit_item AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM hit GROUP BY doc_id
), total AS (
  SELECT doc_id, count(*) AS n_words FROM word GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN hit_word USING (doc_id) LEFT JOIN hit_item USING (doc_id)
"""


# A fixed key, so that the query's result can be compared; callers of the operator keep their own.
DEMONSTRATION_KEY = "papersheaf"


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


def piece_model(path: str = public_tokenizers.path("piece_bpe_32k.model")) -> bytes:
    """The model file, read on the driver like that of ``tokenizer_source``."""
    with open(path, "rb") as file:
        return file.read()


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), piece_model(), limit=4096)


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)
