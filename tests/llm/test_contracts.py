"""Defined results that queries and pipeline rely on: letters of all planes, repeated rows, few labels."""

import duckdb
import pytest

from polysema.llm import langid, linededup, passages, quality


def words(n, start=0):
    return " ".join(f"w{(k * 7919 + start * 104729) % 5003}" for k in range(n))


@pytest.mark.parametrize("text", ["\U0001f600\U0001f600", "\U0001f1e9\U0001f1ea !", "\U0001d7d8\U0001d7d9 \U0001d7da", "123 \U0001f4a9.", "\ue000"])
def test_no_letters_no_language(text):
    model = langid.train([("en", "the quick house " * 5), ("de", "der schöne garten " * 5)] * 4)
    assert langid.predict(text, model) == ("und", 0.0, False)


@pytest.mark.parametrize("text", ["\U00010400\U00010401", "\U00020000\U00020001", "\U0001d504", "the \U0001f600"])
def test_letters_of_further_planes_count(text):
    model = langid.train([("en", "the quick house " * 5), ("de", "der schöne garten " * 5)] * 4)
    assert langid.predict(text, model)[0] in ("en", "de") and langid.predict(text, model)[1] > 0


def test_repeated_rows_give_each_span_once(spark, tmp_path):
    passage = words(60, 3)
    rows = [(1, "alpha beta gamma\nother words"), (2, "alpha beta gamma\nnew"), (2, "alpha beta gamma\nnew"), (3, f"before {passage} after"), (4, f"x y {passage} z"), (4, f"x y {passage} z"), (5, "same\nsame"), (5, "same\nsame"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "unit", "start", "end", "n_words", "kept_doc_id", "kept_start"]
    spans = passages.repeats(docs)
    got = sorted(tuple(r[c] for c in names) for r in spans.collect())
    want = con.execute(f'select {", ".join(chr(34) + c + chr(34) for c in names)} from ({passages.ORACLE_SQL})').fetchall()
    assert got == sorted(want) and {r[:2] for r in got} == {(2, "line"), (4, "passage"), (5, "line")}
    left = sorted((r["doc_id"], r["text"]) for r in passages.remove(docs, spans).where("text is not null").collect())
    assert left == sorted([(1, rows[0][1]), (2, "new"), (2, "new"), (3, rows[3][1]), (4, "x y  z"), (4, "x y  z"), (5, "same\n"), (5, "same\n")])
    assert linededup.repeats(docs).groupBy("doc_id", "text_hash", "start").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("good,bad", [(1, 1), (2, 1), (1, 3), (13, 1), (3, 3)])
def test_few_labels_still_separate(spark, good, bad):
    rows = [(i, words(60, i)) for i in range(100)] + [(1000 + i, "spam " * (50 + i % 9)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    free = [r["doc_id"] for r in docs.select("doc_id").where("pmod(crc32(cast(doc_id as string)), 4) <> 2").orderBy("doc_id").collect()]
    picked = [(i, 1) for i in free if i < 1000][:good] + [(i, 0) for i in free if i >= 1000][:bad]
    model = quality.fit(docs, spark.createDataFrame(picked, "doc_id bigint, quality int"))
    score = {r["doc_id"]: r["score"] for r in quality.add_scores(docs, model).collect()}
    right = sum((score[a] > score[b]) for a in range(100) for b in range(1000, 1100))
    assert right > 9900 and min(score[i] for i in range(100)) > max(score[i] for i in range(1000, 1100)) - 0.5


def test_one_class_of_labels(spark):
    docs = spark.createDataFrame([(i, words(9, i)) for i in range(20)], "doc_id bigint, text string")
    labels = lambda y: spark.createDataFrame([(i, y) for i in range(20)], "doc_id bigint, quality int")
    assert quality.fit(docs, labels(1)).weights == (1.0,) and quality.fit(docs, labels(0)).weights == (0.0,)
    assert quality.accepted(docs, quality.fit(docs, labels(1))).count() == 20
