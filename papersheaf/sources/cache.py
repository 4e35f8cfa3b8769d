"""A vector cache keyed per document text and model.

A cache is a folder of written vector tables and of numbered manifests, each of which lists the tables that belong to the cache from then
on, with their models. Vectors are staged in a table of their own first; a commit writes the next manifest under another name and
renames it, which succeeds for one writer only. A writer that comes second reads the new manifest, leaves out the keys that it has brought
and tries again, so every key of a model stands in one table whatever runs at the same time. Readers see whole commits; staged
tables of runs that failed are in no manifest. Manifests hold one line per commit and model.
"""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Callable

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersheaf.session import materialized

CACHE = "cache_key string, embedding array<float>"
MANIFEST = re.compile(r"(\d+)\.json")


def cache_key(model: str, body: Column) -> Column:
    return F.md5(F.concat_ws("_", F.lit(model), body))


def _path(spark: SparkSession, path: str):
    """A path with its file system, as Spark's JVM sees them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(found), files


def latest_manifest(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """The number of the last commit, 0 for none, and its tables as ``{"table": name, "model": name}``."""
    folder, files = _path(spark, f"{path}/manifests")
    if not files.exists(folder):
        return 0, []
    names = (MANIFEST.fullmatch(status.getPath().getName()) for status in files.listStatus(folder))
    version = max((int(name[1]) for name in names if name), default=0)
    if not version:
        return 0, []
    return version, json.loads(spark.read.text(f"{path}/manifests/{version}.json", wholetext=True).first()[0])


def _vectors(spark: SparkSession, path: str, tables: list[dict], model: str) -> DataFrame:
    folders = [f"{path}/tables/{entry['table']}" for entry in tables if entry["model"] == model]
    return spark.read.schema(CACHE).parquet(*folders) if folders else spark.createDataFrame([], CACHE)


def read_cache(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Cached ``(cache_key, embedding)`` of one model as of the last commit, each key once; a missing cache has no rows."""
    return _vectors(spark, path, latest_manifest(spark, path)[1], model)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a file its final name; false if another one has it already."""
    jvm = spark.sparkContext._jvm
    (old, _), (new, _) = _path(spark, source), _path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(old, new, options)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def _written(spark: SparkSession, path: str, text: str) -> None:
    target, files = _path(spark, path)
    stream = files.create(target, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, vectors: DataFrame, model: str, seen: int) -> DataFrame:
    """Adds ``(cache_key, embedding)``, a written table with each key once and none of commit ``seen``; returns the cache after it."""
    version, tables = latest_manifest(spark, path)
    while True:
        rows = vectors
        if version != seen:  # someone else was faster: what that commit has brought is not added again
            rows = vectors.join(_vectors(spark, path, tables, model).select("cache_key"), "cache_key", "left_anti")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{path}/tables/{name}")
        following = [*tables, {"table": name, "model": model}]
        draft = f"{path}/manifests/draft-{name}"
        _written(spark, draft, json.dumps(following))
        if _renamed(spark, draft, f"{path}/manifests/{version + 1}.json"):
            return _vectors(spark, path, following, model)
        for left in (draft, f"{path}/tables/{name}"):
            target, files = _path(spark, left)
            files.delete(target, True)
        version, tables = latest_manifest(spark, path)


def split_by_cache(keyed: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits with their vectors, distinct missing texts)``."""
    hits = keyed.join(cached, "cache_key")
    misses = keyed.join(cached, "cache_key", "left_anti").select("cache_key", "_body").dropDuplicates(["cache_key"])
    return hits, misses


def incremental_embed(
    documents: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    path: str,
    model: str,
    text_field: str = "full_text",
) -> DataFrame:
    """Vectors of all documents, running ``embed(rows, text column)`` only on texts not yet cached.

    Missing texts are embedded once each and committed to the cache; documents then take their vectors from
    it. When the cache cannot be read or written the vectors are still returned.
    """
    spark = documents.sparkSession
    keyed = materialized(  # texts are made once, for the missing ones and for the result
        documents.withColumn("_body", F.col(text_field)).withColumn("cache_key", cache_key(model, F.col(text_field)))
    )
    try:
        seen, tables = latest_manifest(spark, path)
    except Py4JError:  # no folder can be there
        seen, tables = 0, []
    hits, misses = split_by_cache(keyed, _vectors(spark, path, tables, model))
    embedded = embed(misses, "_body").select("cache_key", F.col("embedding").cast("array<float>").alias("embedding"))
    fresh = materialized(embedded)
    if fresh.isEmpty():
        return hits.drop("_body", "cache_key")
    try:
        vectors = commit(spark, path, fresh, model, seen)
        return keyed.join(vectors, "cache_key").drop("_body", "cache_key")
    except (PySparkException, Py4JError) as error:  # an unwritable folder, a full disk, a failed job
        warnings.warn(f"embedding cache not written: {str(error)[:500]}", stacklevel=2)
    return hits.unionByName(keyed.join(fresh, "cache_key")).drop("_body", "cache_key")
