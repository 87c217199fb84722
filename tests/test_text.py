import pytest
from pyspark.sql import functions as F

from veridoc.functions import text as T


def cut(spark, text, stopwords=T.STOPWORDS):
    return spark.createDataFrame([(text,)], "text string").select(T.tokens(F.col("text"), stopwords).alias("t")).first().t


@pytest.mark.parametrize(
    "text, stopwords, expected",
    [
        ("The QUICK, running runners and tested files.", ("the", "and"), ["quick", "runn", "runner", "test", "fil"]),
        ("... !!!", T.STOPWORDS, []),
        ("this these uses class process need needed doing using es", (), ["thi", "these", "use", "clas", "proces", "need", "need", "doing", "using", "es"]),
        ("this", ("this",), ["thi"]),
        ("café", (), ["caf"]),
        ("\u0130stanbul \u212a", (), ["stanbul"]),
        ("before\0after", (), ["before"]),
        ("", (), []),
        (None, (), []),
    ],
)
def test_tokens(spark, text, stopwords, expected):
    assert cut(spark, text, stopwords) == expected


@pytest.mark.parametrize("n, sizes", [(255, [255]), (256, [255]), (257, [255, 1]), (600, [255, 255, 88])])
def test_long_runs_lose_the_character_that_flushes(spark, n, sizes):
    assert [len(t) for t in cut(spark, "a" * n, ())] == sizes


def test_sentences_windows_names_and_buckets(spark):
    row = spark.createDataFrame([("One. Two! 3.14?", ["a", "b", "c"], "x/y\\essay.txt", 0.85)], "s string, w array<string>, p string, v double").select(
        T.sentences(F.col("s")).alias("s"), T.windows(F.col("w"), 2).alias("two"), T.windows(F.col("w"), 4).alias("four"), T.basename(F.col("p")).alias("p"), T.severity(F.col("v")).alias("v"), T.clamp(F.col("v") * 1000).alias("c")
    ).first()
    assert [x.strip() for x in row.s] == ["One", "Two", "3", "14", ""]
    assert (row.two, row.four, row.p, row.v, row.c) == ([["a", "b"], ["b", "c"]], [], "essay.txt", "Medium", 100.0)
    assert T.csv_field('essay,"one".txt') == '"essay,""one"".txt"' and T.csv_field("plain") == "plain"
