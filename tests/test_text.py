from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.functions import treebank
from polysema.functions import vectors as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_minimize(spark):
    cases = {"ключ": "лю", "-word-": "word", "A": "a", "": "", "über": "ber", " Cat1 ": "cat"}
    for word, form in cases.items():
        assert one(spark, word, X.minimize) == form


def test_parse_cluster(spark):
    got = one(spark, "a:0.5, b:x, c, a:0.25, d#1:0.3, ", X.parse_cluster)
    assert [(r["word"], round(r["sim"], 3), r["pos"]) for r in got] == [("a", 0.25, 1), ("c", round(1 / 3**0.33, 3), 2), ("d#1", 0.3, 3)]
    assert one(spark, "", X.parse_cluster) == []


def test_sense_ids(spark):
    assert tuple(one(spark, "c##1", X.parse_sense)) == ("c#", "1")
    assert one(spark, "word#", X.parse_sense) is None
    assert one(spark, "word", X.parse_sense) is None


def test_find_nth_and_title(spark):
    assert one(spark, "banana", lambda c: X.find_nth(c, "a", 1)) == 3
    assert one(spark, "banana", lambda c: X.find_nth(c, "a", 5)) == -1
    assert one(spark, "python-lang o_k", X.title) == "Python-Lang O_K"


def test_phrases(spark):
    assert X.merged_left_to_right("i love new york city in new york".split(), frozenset({"new_york", "new_york_city"}), 3) == ["i", "love", "new_york_city", "in", "new_york"]
    df = spark.createDataFrame([(["new", "york"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(X.merge_phrases(F.col("t"), ["new_york"])).collect()] == [["new_york"], []]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.normalise(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.quantise(F.lit(-0.00001)).alias("q")).first()
    assert r["n"] == [0.6, 0.8] and r["c"] == 0.0 and r["q"] == -1


def test_csv_clean(spark):
    cases = {"a;b &AMP; c": "a;b   c", "xS;y": "x y", " &quotS;z ": " z", 'q"rSs': "q r s", "&amp": " "}
    for text, clean in cases.items():
        assert one(spark, text.replace("S", chr(92)), X.csv_clean) == clean


def test_patterns(spark):
    cases = {
        "dollar": ("$", "d"), "xml_escape": ("&#39;", "& ;"), "spaced_numbers": ("1, 2", "1 a"), "latin_word": ("Ab-cd", "ab cd"), "latin_mwe": ("AB cd-e", "ab1"), "phone": ("+7 (912) 345-67-89", "12345678901"),
        "url": ("HTTPS://x", "ftp://x"), "upper_letter": ("aB", "ab"), "upper_run": ("ABC", "ABc"), "numeric_stops": ("12:30", "1a"), "norm_babel_dash": ("a-b", "ab"), "number": ("٣", "x"),
    }
    for name, (yes, no) in cases.items():
        assert one(spark, yes, lambda c: X.matches(c, name)) and not one(spark, no, lambda c: X.matches(c, name)), name


def test_lists_and_stop_words(spark):
    assert one(spark, "['a', \"b\", c]", X.parse_list) == ["a", "b", "c"] and one(spark, "[]", X.parse_list) == []
    stop = X.stop_words()
    assert "the" in stop and "often" in stop and "[" in stop
    assert one(spark, "the", X.stop_variants) == ["the", "The", "THE"]
    assert one(spark, "It's 3 p.m., ok_go", treebank.word_tokenize) == ["It", "'s", "3", "p.m.", ",", "ok_go"]
    assert one(spark, "new_york b", lambda c: X.restore_bigrams(F.split(F.translate(c, "_", " "), " "), F.split(c, " "))) == ["new_york", "b"]
