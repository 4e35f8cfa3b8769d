"""Pages to documents, failed records and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.functions import names, text
from papersheaf.functions.binding import once
from papersheaf.sources import files as file_source

MIN_TEXT_LENGTH = 100
METADATA_TYPE = (
    "struct<title:string,author:string,subject:string,creator:string,producer:string,"
    "creation_date:string,modification_date:string,file_size_mb:double,file_extension:string>"
)
DOCUMENT_COLUMNS = [
    "file_path", "filename", "full_text", "page_texts", "page_count", "total_pages",
    "word_count", "char_count", "metadata", "success", "error",
]


def is_valid_page(raw_text: Column, min_text_length: int = MIN_TEXT_LENGTH) -> Column:
    return F.length(text.strip(raw_text)) >= min_text_length


def valid_pages(pages: DataFrame, min_text_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Pages whose stripped raw text is long enough; page numbers are kept."""
    return pages.filter(is_valid_page(F.col("raw_text"), min_text_length))


def _assemble(rows: DataFrame) -> DataFrame:
    """From ``kept ARRAY<STRUCT<page_number, text>>`` (raw, in page order) to text, pages and counts."""
    joined = F.concat(F.array_join(F.col("kept.text"), "\n"), F.lit("\n"))
    return (
        rows.select("*", once(text.clean_text(joined)).alias("full_text"))
        .withColumn(
            "page_texts",
            F.transform(
                "kept", lambda p: F.struct(p.page_number.alias("page_number"), text.clean_text(p.text).alias("text"))
            ),
        )
        .withColumn("page_count", F.size("kept"))
        .withColumn("word_count", text.count_words(F.col("full_text")))
        .withColumn("char_count", text.count_chars(F.col("full_text")))
        .drop("kept")
    )


def assemble_nested(parsed: DataFrame, min_text_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Assemble documents whose pages already sit in one row (``raw_pages``): no shuffle."""
    numbered = F.transform(
        "raw_pages", lambda p, i: F.struct((i + 1).cast("int").alias("page_number"), p.alias("text"))
    )
    kept = F.filter(numbered, lambda p: is_valid_page(p.text, min_text_length))
    rows = parsed.withColumn("total_pages", F.size("raw_pages")).withColumn("kept", kept).drop("raw_pages")
    return _assemble(rows)


def assemble_document(pages: DataFrame, min_text_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Assemble documents from long ``(doc_id, page_number, raw_text)`` rows.

    Raw valid pages are joined in page order, then cleaned. A group holds the pages of one document, whole;
    the limit on file sizes belongs to ``validate_files`` and ``extract_documents``.
    """
    page = F.struct(F.col("page_number").cast("int").alias("page_number"), F.col("raw_text").alias("text"))
    gathered = (
        pages.groupBy("doc_id")
        .agg(
            F.array_sort(
                F.collect_list(F.when(is_valid_page(F.col("raw_text"), min_text_length), page))
            ).alias("kept"),
            F.count("*").cast("int").alias("total_pages"),
        )
    )
    return _assemble(gathered).withColumn("success", F.lit(True)).withColumn("error", F.lit(None).cast("string"))


def empty_records(rows: DataFrame, error: Column) -> DataFrame:
    """Add the fields of a document that could not be read."""
    pages_type = "array<struct<page_number:int,text:string>>"
    return rows.withColumns(
        {
            "full_text": F.lit(""),
            "page_texts": F.array().cast(pages_type),
            "page_count": F.lit(0),
            "total_pages": F.lit(0),
            "word_count": F.lit(0),
            "char_count": F.lit(0),
            "success": F.lit(False),
            "error": error,
        }
    )


def failed_records(inventory: DataFrame, documents: DataFrame, error: Column | None = None) -> DataFrame:
    """Every file of the inventory: its document, or an empty failed record when there is none."""
    missing = inventory.join(documents.select("doc_id"), "doc_id", "left_anti")
    failed = empty_records(missing, F.lit("Invalid file") if error is None else error)
    good = inventory.join(documents, "doc_id")
    return good.unionByName(failed.select(*good.columns))


def extract_documents(
    files: DataFrame,
    parser: file_source.Parser,
    min_text_length: int = MIN_TEXT_LENGTH,
    max_file_size_mb: float = file_source.MAX_FILE_SIZE_MB,
) -> DataFrame:
    """Files with content to document records, in one narrow stage.

    The size test is a filter on ``length``, which the file source applies before it opens a file. A file without
    a length, as for a missing one, comes out as a failed record like one beyond the limit.
    """
    limit = int(max_file_size_mb * 1024 * 1024)
    is_pdf = F.lower(names.extension(F.col("path"))) == ".pdf"
    usable = (F.col("length") <= limit) & is_pdf
    parsed = file_source.extract_pages(files.filter(usable).select("path", "length", "content"), parser)
    read = assemble_nested(parsed, min_text_length).withColumn("success", F.col("error").isNull())
    read = read.withColumn(
        "metadata",
        F.when(
            F.col("success"),
            file_source.document_metadata(F.col("path"), F.col("length"), F.col("properties")),
        ).cast(METADATA_TYPE),
    )
    rejected = empty_records(
        files.filter(~F.coalesce(usable, F.lit(False))).select("path", "length"), F.lit("Invalid file")
    ).withColumn("metadata", F.lit(None).cast(METADATA_TYPE))

    def record(rows: DataFrame) -> DataFrame:
        return rows.withColumn("file_path", F.col("path")).withColumn("filename", names.basename(F.col("path")))

    return (
        record(read)
        .select(*DOCUMENT_COLUMNS)
        .unionByName(record(rejected).select(*DOCUMENT_COLUMNS))
        .withColumn("doc_id", F.col("file_path"))
    )


def extraction_summary(documents: DataFrame) -> DataFrame:
    """One row: files and successes."""
    return documents.agg(
        F.count("*").alias("total_files"),
        F.count_if("success").alias("successful"),
    )


def extraction_details(documents: DataFrame) -> DataFrame:
    """Per file: word count, character count and status."""
    return documents.select(
        "filename", "word_count", "char_count", F.when(F.col("success"), "Success").otherwise("Failed").alias("status")
    )


def embeddable_documents(documents: DataFrame, text_field: str = "full_text") -> DataFrame:
    return documents.filter(F.col("success") & (text.strip(F.col(text_field)) != ""))


def text_characteristics(documents: DataFrame, text_field: str = "full_text") -> DataFrame:
    """Length, words, sentence marks, mean word length and distinct lower-case words of cleaned texts."""
    body = F.col(text_field)
    word_count = text.count_words(body)
    letters = F.length(F.translate(body, " ", ""))
    return documents.select(
        "doc_id",
        F.length(body).alias("length"),
        word_count.alias("words"),
        text.sentence_marks(body).alias("sentences"),
        F.try_divide(letters, word_count).alias("avg_word_length"),
        F.size(F.array_distinct(text.words(F.lower(body)))).alias("unique_words"),
    )


def corpus_statistics(characteristics: DataFrame) -> DataFrame:
    return characteristics.agg(
        F.avg("words").alias("avg_words"),
        F.avg("length").alias("avg_characters"),
        F.avg(F.try_divide(F.col("unique_words"), F.col("words"))).alias("avg_vocabulary_diversity"),
    )
