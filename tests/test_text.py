import pytest
from pyspark.sql import functions as F

from lexmill.config import LATIN, THAI, ModelConfig
from lexmill.functions import text as T
from lexmill.functions.tokens import collapsed, in_vocabulary, segmenter, segments, tokenize, with_boundaries


@pytest.mark.parametrize(("token", "valid"), [("", False), ("ก", False), ("hello", False), ("123", False), ("ก.", False), ("ๆๆๆ", False), ("ๆคน", False), ("ดดดด", False), ("าาา", False), ("ะะ", False), ("ดดด", False), ("กกก", False), ("คน", True), ("แบบบาง", True), ("ก" * 15 + "ข" * 16, False)])
def test_thai_validity(spark, token, valid):
    assert spark.createDataFrame([(token,)], "t string").select(T.is_valid(F.col("t"), THAI)).first()[0] is valid


def test_latin_validity(spark):
    rows = spark.createDataFrame([(t,) for t in ("the", "a", "aaab", "aaaab", "xx", "a\n", "größe", "ab1")], "t string").select("t", T.is_valid(F.col("t"), LATIN).alias("v")).collect()
    assert {r.t for r in rows if r.v} == {"the", "aaab", "größe"}


def test_wikitext(spark):
    text = "'''A''' [[B|C]] [[D]] {{t|{{u}}}}<ref>r</ref> [http://x y]"
    assert spark.createDataFrame([(text,)], "t string").select(T.clean_wikitext(F.col("t"))).first()[0] == "A C D  "
    more = "== H ==\n* item\n<!-- a\nb -->{| t\n|}x[[File:a.png]][[Category:c]]"
    assert spark.createDataFrame([(more,)], "t string").select(T.clean_wikitext(F.col("t"))).first()[0] == "\nitem\nx"


def test_measures(spark):
    df = spark.createDataFrame([("เรียน", ["ab", "abc", "xyz"], [])], "w string, r array<string>, e array<string>")
    r = df.select(T.longest(F.col("r")).alias("l"), T.shortest(F.col("r")).alias("s"), T.longest(F.col("e")).alias("n"), T.shortest(F.col("e")).alias("z"), T.nuclei(F.col("w"), THAI).alias("u"), T.vowel_clusters(F.lit("sawatdii")).alias("c"), T.has_cluster(F.lit("Khon")).alias("k"), T.query_text(F.lit("A b C")).alias("q"), T.strip_space(F.lit(" \t x \n")).alias("x")).first()
    assert tuple(r) == ("abc", "ab", "", "", 1, 3, True, "abc", "x")


def test_boundaries(spark):
    df = spark.createDataFrame([("1 ab 2 3 cd ef 4",), ("1 2",), ("",)], "text string")
    got = [r[0] for r in df.select(with_boundaries(F.col("text"), LATIN)).collect()]
    assert got == [[None, "ab", None, None, "cd", "ef", None], [None, None], []]
    assert [r[0] for r in df.select(collapsed(with_boundaries(F.col("text"), LATIN))).collect()] == [["ab", None, "cd", "ef"], [], []]


def test_segments(spark):
    df = spark.createDataFrame([(1, [None, "a", None, "b", "c"]), (2, [])], "id int, tokens array<string>")
    assert [tuple(r) for r in segments(df).orderBy("pos").collect()] == [(1, 2, 1, "a"), (1, 4, 2, "b"), (1, 5, 2, "c")]


@pytest.mark.parametrize("limit", [10, 0])
def test_vocabulary(spark, limit):
    df = spark.createDataFrame([("x", ["a", "c", None, "b"])], "corpus string, tokens array<string>")
    v = spark.createDataFrame([("a",), ("b",)], "word string")
    assert in_vocabulary(df, v, limit=limit).first()["tokens"] == ["a", None, None, "b"]


def test_maximal_matching():
    assert segmenter(["ab", "abc", "cd", "d"])("abcd xabc") == ["abc", "d", "x", "abc"]
    assert segmenter([])("zz") == ["zz"]


def test_tokenize_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(tokenize(F.col("t"), LATIN)).first()[0] is None


def test_smoothing_is_checked():
    with pytest.raises(ValueError):
        ModelConfig(smoothing="mkn")
