"""Commands over given clusters, lists and corpora."""

import polysema.__main__ as cli
from polysema.sources import readers, writers


def test_frequencies_labels_and_similarity(spark, tmp_path):
    (tmp_path / "c.txt").write_text("b a b\nc b a\n")
    cli.main(["frequencies", "--corpus", f"{tmp_path}/c.txt", "--least", "2", "--out", f"{tmp_path}/f"])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/f").orderBy("value").collect()] == ["a 2", "b 3"]
    member = lambda w, i: {"word": w, "sim": 1.0 / i, "pos": i}
    rows = [("x", "1", [member("cat", 1), member("dog", 2)]), ("cat", "1", [member("x", 1), member("dog", 2)])]
    writers.clusters(spark.createDataFrame(rows, "word string, cid string, cluster array<struct<word string, sim double, pos int>>"), f"{tmp_path}/k")
    (tmp_path / "r.tsv").write_text("hyponym\thypernym\tfreq\ncat\tanimal\t3\ndog\tanimal\t2\n")
    cli.main(["label", "--clusters", f"{tmp_path}/k", "--relations", f"{tmp_path}/r.tsv", "--min-size", "1", "--out", f"{tmp_path}/l"])
    found = {(r["word"], r["hyper"]): r["score"] for r in spark.read.parquet(f"{tmp_path}/l/labels").collect()}
    assert found == {("x", "animal"): 4.0, ("cat", "animal"): 1.0}
    writers.word2vec(spark.createDataFrame([("a#1", [1.0, 0.0]), ("a#2", [0.0, 1.0]), ("b#1", [0.0, 2.0])], "word string, v array<float>"), f"{tmp_path}/v")
    (tmp_path / "p.csv").write_text("id;word1;word2;score;\n1;a;b;0.9;\n2;a;zz;0.1;\n")
    cli.main(["similarity", "--sense-vectors", f"{tmp_path}/v", "--pairs", f"{tmp_path}/p.csv", "--out", f"{tmp_path}/s"])
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/s/similarities").collect()) == ["a,b,1.000000", "a,zz,0.000000"]
    assert readers.word_pairs(spark, f"{tmp_path}/p.csv").count() == 2
