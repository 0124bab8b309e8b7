"""The tokenizer's published examples, word for word."""

import duckdb
import pytest
from pyspark.sql import functions as F

from polysema.functions import treebank

EXAMPLES = [
    ("Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\nThanks.", "Good muffins cost $ 3.88 in New York . Please buy me two of them . Thanks ."),
    ("They'll save and invest more.", "They 'll save and invest more ."),
    ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
    ("I cannot cannot work under these conditions!", "I can not can not work under these conditions !"),
    ("The company spent $30,000,000 last year", "The company spent $ 30,000,000 last year"),
    ("The company spent 40.75% of its income last year.", "The company spent 40.75 % of its income last year ."),
    ("He arrived at 3:00 pm", "He arrived at 3:00 pm"),
    ("I bought these items: books, pencils, and pens.", "I bought these items : books , pencils , and pens ."),
    ("Though there were 150, 100 of them were old.", "Though there were 150 , 100 of them were old ."),
    ("There were 300,000, but that wasn't enough.", "There were 300,000 , but that was n't enough ."),
    ("It's more'n enough.", "It 's more 'n enough ."),
    ('"We beat some pretty good teams to get here," Slocum said.', "`` We beat some pretty good teams to get here , '' Slocum said ."),
    ("«Now that I can do.»", "« Now that I can do . »"),
    ("The unicode 201C and 201D “LEFT(RIGHT) DOUBLE QUOTATION MARK” is also OPEN_PUNCT and CLOSE_PUNCT.", "The unicode 201C and 201D “ LEFT ( RIGHT ) DOUBLE QUOTATION MARK ” is also OPEN_PUNCT and CLOSE_PUNCT ."),
    ("'Tis gonna be fun -- wanna go? Gimme [that] {one}...", "'T is gon na be fun -- wan na go ? Gim me [ that ] { one } ..."),
    ("Alas, it has not rained today. When, do you think, will it rain again?", "Alas , it has not rained today . When , do you think , will it rain again ?"),
    ("Mr. Smith met J. Doe etc. in Berlin. They left at 5 p.m. sharp; e.g. by car... or so. End", "Mr. Smith met J. Doe etc. in Berlin . They left at 5 p.m. sharp ; e.g. by car ... or so . End"),
    ("a*b & c#d @e '' \"q\"", "a * b & c # d @ e `` `` q ''"),
    ("", ""),
    (" \n ", ""),
]


def test_published_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXAMPLES)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", treebank.word_tokenize(F.col("t")).alias("w")).collect()}
    for i, (t, want) in enumerate(EXAMPLES):
        assert got[i] == want.split(), (t, got[i])
    assert got[99] is None


def test_sql_has_the_same_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXAMPLES)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", treebank.word_tokenize(F.col("t")).alias("w")).collect()}
    con = duckdb.connect()
    con.execute("create table x (i int, t varchar)")
    con.executemany("insert into x values (?, ?)", [(i, t) for i, (t, _) in enumerate(EXAMPLES)])
    assert dict(con.execute(f"select i, {treebank.sql('t')} from x").fetchall()) == got


@pytest.mark.parametrize("text,want", [("One. Two? Three! four", ["One.", "Two?", "Three!", "four"]), ("Dr. No said: \"Go.\" He went.", ['Dr. No said: "Go."', "He went."]), ("Wait... what? Yes.", ["Wait... what?", "Yes."])])
def test_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(treebank.sentences(F.col("t"))).first()[0] == want
