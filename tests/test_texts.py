import pytest
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import chunking


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, "The Foo-bar, 1,456,779 in the 1820s", text.tokens) == ["foo", "bar", "1", "456", "779", "1820s"]
    assert one(spark, None, text.tokens) == []


@pytest.mark.parametrize(
    ("query", "groups"),
    [
        ("in the 1820s", [[str(y) for y in range(1820, 1830)]]),
        ("1,456,779", [["1"], ["456"], ["779"]]),
        ("12345", []),
        ("90s", [["90"]]),
        ("1825s", [["1825"]]),
        (None, []),
    ],
)
def test_number_groups(spark, query, groups):
    assert one(spark, query, text.number_groups) == groups


def test_page_id(spark):
    assert one(spark, " 42 \n", text.page_id) == 42
    for bad in ("-1", "x", None, ""):
        with pytest.raises(Exception, match="not a page id"):
            one(spark, bad, text.page_id)


def test_sentences_and_words(spark):
    assert one(spark, " A b.  C d!\nE?  ", text.sentences) == ["A b.", "C d!", "E?"]
    assert one(spark, "a b.  c", text.sentences) == ["a b.", "c"]
    assert one(spark, None, text.sentences) == []
    assert [one(spark, x, text.words) for x in ("a b  c\n", " ", None)] == [3, 0, 0]


@pytest.mark.parametrize(
    ("title", "content", "chunks"),
    [
        ("T", "A b. C d. E.", ["T. A b. C d.", "T. C d. E."]),
        ("", "A b. C d.", ["A b. C d.", "C d."]),
        (None, "A b c d e.", ["A b c d e."]),
        ("T", "", ["T. T"]),
        (None, None, ["7"]),
        ("  ", "A b c d e.", ["A b c d e."]),
        (" T\t", " A b c d e. ", ["T. A b c d e."]),
        ("  ", " ", ["7"]),
    ],
)
def test_chunks(spark, title, content, chunks):
    pages = spark.createDataFrame([(7, title, content)], "page_id bigint, title string, content string")
    rows = chunking.chunks(pages, 4).orderBy("chunk_id").collect()
    assert [r["text"] for r in rows] == chunks
    assert [r["chunk_id"] for r in rows] == list(range(len(chunks)))


@pytest.mark.parametrize(("title", "content", "entry"), [("T", "x ", "T\n\nx"), ("", " x", "x"), (None, "x", "x"), ("  ", "x", "x"), ("T", None, "T"), (None, None, "")])
def test_entry_text(spark, title, content, entry):
    row = spark.createDataFrame([(title, content)], "t string, c string").select(text.entry_text("t", "c").alias("x")).first()
    assert row["x"] == entry


def test_connective(spark):
    assert one(spark, "How do A and B Connect?", text.connective) is True
    assert one(spark, "reconnection", text.connective) is False
    assert one(spark, None, text.connective) is False
