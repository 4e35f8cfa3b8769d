import re

import pytest
from pyspark.sql import functions as F

from papersheaf.functions import names, text
from papersheaf.operators import documents, naming
from papersheaf.sources import files

DIRTY = [
    ("\tTwo\r\n lines ~ of <odd>  signs?!  ", "Two lines of odd signs?!"),
    ("", ""),
    (None, ""),
    ("abc", ""),
    ("abcd", "abcd"),
    ("a@ b", "a b"),
    ("a@b", ""),
    ("naïve_x", "naïve_x"),
    (" café ok\x1c", "café ok"),
    ("@@@@@@", ""),
]


def python_rule(body):
    """Letters, digits and some signs stay, all else parts words; what is left of three characters is nothing."""
    spaced = "".join(c if c.isalnum() or c in "_.,!?;:-()" else " " for c in " ".join((body or "").split()))
    return " ".join(spaced.split()) if len(spaced.strip()) > 3 else ""


@pytest.mark.parametrize("body, expected", DIRTY)
def test_clean_text_edges(spark, body, expected):
    rows = spark.createDataFrame([(body,)], "t string")
    assert rows.select(text.clean_text(F.col("t"))).first()[0] == expected == python_rule(body)


def test_clean_text_matches_python_on_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in rows.select("text", text.clean_text(F.col("text")).alias("c")).collect():
        assert row.c == python_rule(row.text)


def test_counts_and_words(spark):
    rows = spark.createDataFrame([("",), ("one",), ("one two  x".replace("  ", " "),)], "c string")
    got = rows.select(text.count_words(F.col("c")), text.count_chars(F.col("c")), F.size(text.words(F.col("c"))))
    assert [tuple(r) for r in got.collect()] == [(0, 0, 0), (1, 3, 1), (3, 9, 3)]
    long = spark.createDataFrame([(" ".join(str(i) for i in range(600)),)], "c string")
    cut = long.select(text.first_n_words(F.col("c"))).first()[0]
    assert cut.split() == [str(i) for i in range(512)]


def test_whole_words_only(spark):
    rows = spark.createDataFrame([("Tests café data_base abcd1 word,next the",)], "c string")
    found = rows.select(text.lowercase_words(F.col("c"))).first()[0]
    assert found == re.findall(r"\b[a-z]{4,}\b", "tests café data_base abcd1 word,next the")


def test_sanitize_name(spark):
    cases = {
        "which: one? <two>*three": "which_ one_ _two_three",
        "__a__b__": "a_b",
        "x" * 60: "x" * 47 + "...",
        "x" * 50: "x" * 50,
        'a/b\\c:d"e': "a_b_c_d_e",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r[0]: r[1] for r in rows.select("n", names.sanitize_name(F.col("n"))).collect()}
    assert got == cases


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.c.PDF",), (".hidden",), ("plain",)], "p string")
    got = rows.select(names.stem(F.col("p")), names.extension(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("b.c", ".PDF"), (".hidden", ""), ("plain", "")]
    made = rows.select(names.archive_path(F.lit("A b (3docs)"), F.lit("d.pdf"))).first()[0]
    assert made == "A_b_3docs/d.pdf"


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, page_number int, raw_text string")


def test_assemble_keeps_page_order_and_numbers(spark):
    rows = pages(spark, [(1, 2, "second page text"), (1, 3, "x"), (1, 1, "first  page text"), (2, 1, " ")])
    got = {r.doc_id: r for r in documents.assemble_document(rows, min_text_length=5).collect()}
    assert got[1].full_text == "first page text second page text"
    assert [(p.page_number, p.text) for p in got[1].page_texts] == [(1, "first page text"), (2, "second page text")]
    assert (got[1].page_count, got[1].total_pages, got[1].word_count, got[1].char_count) == (2, 3, 6, 32)
    assert (got[2].full_text, got[2].page_count, got[2].success) == ("", 0, True)


def test_nested_and_long_assembly_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    nested = documents.assemble_nested(rows.select("doc_id", F.split("text", "\n").alias("raw_pages")), 20)
    long = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw_text"))
    long = documents.assemble_document(long.withColumn("page_number", F.col("i") + 1), 20)
    columns = ["doc_id", "full_text", "page_texts", "page_count", "total_pages", "word_count", "char_count"]
    assert nested.select(columns).exceptAll(long.select(columns)).isEmpty()


def test_long_documents_stay_whole(spark):
    rows = pages(spark, [(1, i, "z" * 1000) for i in range(5000)] + [(2, 1, "fine text here")])
    got = {r.doc_id: r for r in documents.assemble_document(rows, 5).collect()}
    assert (got[1].success, got[1].page_count, got[1].char_count) == (True, 5000, 5000 * 1001 - 1)
    assert got[2].success


def test_file_without_length_becomes_failed_record(spark):
    rows = [("/a.pdf", 3, b"a page of text"), ("/b.pdf", None, None), ("/c.txt", None, b""), (None, 4, b"x")]
    table = spark.createDataFrame(rows, "path string, length long, content binary")
    got = documents.extract_documents(table, lambda data: [data.decode()], 5).collect()
    assert {r.file_path: (r.success, r.error) for r in got} == {
        "/a.pdf": (True, None), "/b.pdf": (False, "Invalid file"), "/c.txt": (False, "Invalid file"), None: (False, "Invalid file"),
    }


def test_files_end_to_end(spark, tmp_path):
    body = "\f".join(["The first page holds plenty of text.", "no", "Another page with words."])
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(body.encode())
    (tmp_path / "sub" / "b.PDF").write_bytes(b"\xff\xfe broken")
    (tmp_path / "big.pdf").write_bytes(b"x" * 5000)
    (tmp_path / "c.txt").write_bytes(b"not listed")

    def parser(data):
        return data.decode("utf-8").split("\f"), {"title": "T", "creationDate": "D:2020"}

    inventory = files.scan_files(spark, str(tmp_path))
    assert "content" not in inventory.columns and inventory.count() == 3
    assert files.scan_files(spark, str(tmp_path), recursive=False).count() == 2
    assert files.scan_files(spark, str(tmp_path / "missing")).count() == 0

    found = documents.extract_documents(
        files.scan_files(spark, str(tmp_path), with_content=True), parser, 10, max_file_size_mb=0.004
    )
    got = {r.filename: r for r in found.collect()}
    good = got["a.pdf"]
    assert good.success and good.page_count == 2 and good.total_pages == 3
    assert [p.page_number for p in good.page_texts] == [1, 3]
    assert good.metadata.title == "T" and good.metadata.author == "" and good.metadata.file_extension == ".pdf"
    assert not got["b.PDF"].success and "decode" in got["b.PDF"].error
    assert got["big.pdf"].error == "Invalid file"
    assert documents.extraction_summary(found).first() == (3, 1)
    assert documents.embeddable_documents(found).count() == 1


def test_size_limit_is_pushed_to_the_listing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    rows = files.scan_files(spark, str(tmp_path), with_content=True).filter("length <= 10")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan


def named(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, cluster_id int, full_text string, document_name string")


def test_content_names(spark):
    rows = named(
        spark,
        [
            (1, 0, "The neural network learns; machine learning model", "a.pdf"),
            (2, 1, "zebra zebra apple apple banana", "b.pdf"),
            (3, 2, "once only here", "c.pdf"),
            (4, 3, "network network", "d.pdf"),
        ],
    )
    got = dict(naming.content_names(rows).collect())
    # cluster 3: both Technology and AI score 2, the first listed wins
    assert got == {
        0: "AI_Machine_Learning_(1docs)",
        1: "Zebra_Apple_(1docs)",
        2: "Topic_2_(1docs)",
        3: "Technology_(1docs)",
    }


def test_filename_and_theme_names(spark):
    rows = named(
        spark,
        [
            (1, 0, "patient patient clinical trial", "report_2020-final.pdf"),
            (2, 0, "clinical words", "Report_the_pdf.pdf"),
            (3, 1, "world, world, other", "x1.pdf"),
            (4, 2, "tiny", "12345.pdf"),
        ],
    )
    assert naming.filename_keywords(rows).collect() == [(0, 1, "report", 2)]
    assert dict(naming.filename_names(rows).collect()) == {0: "report_2files", 1: "group_1_1files", 2: "group_2_1files"}
    assert dict(naming.theme_names(rows).collect()) == {
        0: "Healthcare_Research",
        1: "World,",
        2: "Mixed_Documents_2",
    }


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_assembly_from_files_needs_no_shuffle(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    nested = documents.assemble_nested(rows.select("doc_id", F.split("text", "\n").alias("raw_pages")), 20)
    assert "Exchange" not in plan_of(documents.embeddable_documents(nested.withColumn("success", F.lit(True))))


def test_words_are_counted_by_hash_and_ranked_before_the_shuffle(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rows.select("doc_id", F.lit(1).alias("cluster_id"), F.col("text").alias("full_text"))
    counts = plan_of(naming.word_counts(rows))
    assert "HashAggregate" in counts and "SortAggregate" not in counts
    assert "WindowGroupLimit" in plan_of(naming.cluster_top_words(rows))
