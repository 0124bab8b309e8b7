import random

import polysema.__main__ as cli
from polysema.operators import cluster
from polysema.plans import catalogue, training
from polysema.sources import readers, writers
from polysema.streaming import corpus as stream


def test_training_chain_is_reused(spark, tmp_path):
    r = random.Random(1)
    v = spark.createDataFrame([(f"w{i}w", [r.gauss(0, 1) for _ in range(4)]) for i in range(20)], "word string, v array<double>")
    s = training.Settings(neighbours=5, edges=5, min_size=2)
    first = training.train(spark, str(tmp_path), vectors=v, settings=s)
    again = training.train(spark, str(tmp_path), vectors=v, settings=s)
    assert first["inventory"].count() == again["inventory"].count() > 0
    assert first["clusters"].exceptAll(first["all_clusters"]).isEmpty()


def test_training_with_phrases_substrings_and_relations(spark, tmp_path):
    r = random.Random(2)
    words = [f"{a}{b}" for a in "klm" for b in "opqrst"]
    lines = [" ".join(r.choice(words) for _ in range(12)) + " new york city new york" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    phrases = spark.createDataFrame([("new york",)], "phrase string")
    isa = spark.createDataFrame([(w, "thing", 3.0) for w in words], "hypo string, hyper string, freq double")
    s = training.Settings(size=4, iterations=1, min_count=5, neighbours=6, edges=6, min_size=2)
    out = training.train(spark, str(tmp_path), docs=docs, settings=s, phrases=phrases, isa=isa)
    known = {x["word"] for x in out["vectors"].collect()}
    assert "new_york" in known and "york" not in known
    assert {x["hyper"] for x in out["labels"].collect()} == {"thing"}
    members = out["disambiguated"].where("sense not like '%?%'").groupBy("word", "cid").count()
    sizes = {(x["word"], x["cid"]): x["count"] for x in members.collect()}
    closed = out["closure"].collect()
    assert closed and all(len(x["cluster"]) == sizes.get((x["word"], x["cid"]), 0) and x["kept"] == (len(x["cluster"]) >= 2) for x in closed)


def test_commands(spark, tmp_path, capsys):
    r = random.Random(3)
    rows = [(f"w{i}w", [r.gauss(0, 1) for _ in range(4)]) for i in range(20)] + [("w1w_x", [0.1, 0.2, 0.3, 0.4])]
    writers.word2vec(spark.createDataFrame(rows, "word string, v array<float>"), f"{tmp_path}/v")
    cli.main(["train", "--vectors", f"{tmp_path}/v", "--out", f"{tmp_path}/m", "--neighbours", "5", "--edges", "5", "--min-size", "2"])
    assert any(x["member"] == "w1w_x" for x in cluster.unfolded(readers.clusters(spark, f"{tmp_path}/m/clusters")).where("word = 'w1w'").collect())
    cli.main(["filter-clusters", "--clusters", f"{tmp_path}/m/clusters", "--min-size", "3", "--out", f"{tmp_path}/big"])
    assert cluster.unfolded(readers.clusters(spark, f"{tmp_path}/big")).where("size < 3").isEmpty()
    cli.main(["sense-vectors", "--clusters", f"{tmp_path}/m/clusters", "--vectors", f"{tmp_path}/v", "--out", f"{tmp_path}/s"])
    ids = lambda p: {(x["word"], x["cid"]) for x in readers.inventory(spark, p).collect()}
    assert ids(f"{tmp_path}/s/inventory") == ids(f"{tmp_path}/m/inventory") != set()
    head = "context_id target target_pos target_position gold_sense_ids predict_sense_ids golden_related predict_related context"
    (tmp_path / "t.tsv").write_text("\t".join(head.split()) + "\n" + "\t".join(["1", "w2w", "", "4,7", "0", "", "", "", "w3w w2w w4w w5w"]) + "\n" + "\t".join(["2", "none", "", "0,4", "0", "", "", "", "none w4w"]) + "\n")
    cli.main(["predict", "--inventory", f"{tmp_path}/m/inventory", "--sense-vectors", f"{tmp_path}/m/sense_vectors", "--vectors", f"{tmp_path}/v", "--test", f"{tmp_path}/t.tsv", "--out", f"{tmp_path}/p"])
    found = {x["context_id"]: x["predict_sense_ids"] for x in readers.wsd_set(spark, f"{tmp_path}/p").collect()}
    assert found["2"] == "0" and ("w2w", found["1"]) in ids(f"{tmp_path}/m/inventory")
    cli.main(["anti", "--vectors", f"{tmp_path}/v", "--top", "3", "6", "--out", f"{tmp_path}/a"])
    assert readers.keyword_inventory(spark, f"{tmp_path}/a/top6").columns == ["word", "cid", "keyword", "cluster"]


def test_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a b a\n")
    q = stream.term_frequencies(stream.lines(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("freq").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("freq").collect()} == {("a", 2), ("b", 1)}


def test_catalogue_sql_belongs_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
