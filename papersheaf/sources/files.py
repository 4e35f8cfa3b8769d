"""File inventory, validation and the parser hook."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersheaf.functions import names
from papersheaf.session import ship_package

MAX_FILE_SIZE_MB = 50
PDF_GLOB = "*.[pP][dD][fF]"
INVENTORY = "path string, modificationTime timestamp, length bigint"

# Property names a parser reports, by field of the metadata record.
METADATA_PROPERTIES = {
    "title": "title",
    "author": "author",
    "subject": "subject",
    "creator": "creator",
    "producer": "producer",
    "creation_date": "creationDate",
    "modification_date": "modDate",
}

Parser = Callable[[bytes], "list[str] | tuple[list[str], dict[str, str]]"]


def scan_files(
    spark: SparkSession,
    directory: str,
    recursive: bool = True,
    glob: str = PDF_GLOB,
    with_content: bool = False,
) -> DataFrame:
    """One row per file; a missing directory gives no rows.

    Without ``content`` only file listings are read.
    """
    columns = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
    )
    try:
        return reader.load(directory).select(*columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INVENTORY + (", content binary" if with_content else ""))


def entry_name(path: Column, directory: str) -> Column:
    """The file or folder directly in ``directory`` that ``path`` is or lies in."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", directory).rstrip("/")
    below = F.substring(path, F.locate(f"{plain}/", path) + F.lit(len(plain) + 1), F.length(path))
    return F.substring_index(below, "/", 1)


def reject_reason(path: Column, length: Column, max_file_size_mb: float = MAX_FILE_SIZE_MB) -> Column:
    """Null for a usable file, else why it cannot be used; a null length means a missing file."""
    return (
        F.when(length.isNull(), "File not found")
        .when(F.lower(names.extension(path)) != ".pdf", "Not a PDF file")
        .when(length > int(max_file_size_mb * 1024 * 1024), "File too large")
    )


def validate_files(inventory: DataFrame, max_file_size_mb: float = MAX_FILE_SIZE_MB) -> DataFrame:
    """Add ``valid`` and ``reject_reason``."""
    reason = reject_reason(F.col("path"), F.col("length"), max_file_size_mb)
    return inventory.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())


def extract_pages(files: DataFrame, parser: Parser, content: str = "content") -> DataFrame:
    """Run ``parser(bytes)`` on every file inside the tasks.

    The content column is replaced by ``raw_pages ARRAY<STRING>``, ``properties MAP`` and ``error``;
    a parser that raises gives a row with its message and no pages. The pages of a file stay in one
    row, so that documents can be assembled without a shuffle; ``page_rows`` gives the long form.
    """
    ship_package(files.sparkSession)
    kept = [field for field in files.schema.fields if field.name != content]
    schema = T.StructType(
        [
            *kept,
            T.StructField("raw_pages", T.ArrayType(T.StringType())),
            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def parse(data: bytes) -> tuple[list[str], dict[str, str], str | None]:
        try:
            parsed = parser(bytes(data))
            pages, properties = parsed if isinstance(parsed, tuple) else (parsed, {})
            return list(pages), dict(properties), None
        except Exception as error:  # a bad file is a row, not a failed job
            return [], {}, str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse(data) for data in batch[content]]
            rest = batch.drop(columns=[content])
            rest["raw_pages"], rest["properties"], rest["error"] = zip(*parsed) if parsed else ([], [], [])
            yield rest

    return files.mapInPandas(run, schema)


def page_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of ``extract_pages``: one row per page with its 1-based ``page_number``."""
    return parsed.select(*keys, F.posexplode("raw_pages").alias("_position", "raw_text")).select(
        *keys, (F.col("_position") + 1).alias("page_number"), "raw_text"
    )


def document_metadata(path: Column, length: Column, properties: Column) -> Column:
    """The nine-field record; absent properties become ``''``, dates stay strings."""
    reported = [
        F.coalesce(properties[name], F.lit("")).alias(field) for field, name in METADATA_PROPERTIES.items()
    ]
    return F.struct(
        *reported,
        names.megabytes(length).alias("file_size_mb"),
        F.lower(names.extension(path)).alias("file_extension"),
    )
