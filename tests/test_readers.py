"""Readers that no registered query meets, on small files."""

import numpy as np

from polysema.sources import readers


def test_binary_vectors(spark, tmp_path):
    v = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "v.bin").write_bytes(b"2 3\n" + b"one " + v[0].tobytes() + b"\n" + "zwö ".encode() + v[1].tobytes() + b"\n")
    got = {r["word"]: list(r["v"]) for r in readers.word2vec_binary(spark, str(tmp_path / "v.bin")).collect()}
    assert got == {"one": [0, 1, 2], "zwö": [3, 4, 5]}


def test_pairs_and_contexts(spark, tmp_path):
    (tmp_path / "gold.tsv").write_text("word1\tword2\tgold\na\tb\t0.5\n")
    assert [tuple(r) for r in readers.gold_pairs(spark, str(tmp_path / "gold.tsv")).collect()] == [("a", "b", 0.5)]
    (tmp_path / "pairs.csv").write_text("word1,word2\na,b\nc,d\n")
    assert [tuple(r) for r in readers.csv_pairs(spark, str(tmp_path / "pairs.csv")).collect()] == [("a", "b"), ("c", "d")]
    (tmp_path / "ctx.tsv").write_text('word\tcontext\nbank\tthe "river" bank\n')
    assert [tuple(r) for r in readers.contexts(spark, str(tmp_path / "ctx.tsv")).collect()] == [("bank", 'the "river" bank')]


def test_evaluated_set(spark, tmp_path):
    head = "context_id target target_pos target_position gold_sense_ids predict_sense_ids golden_related predict_related context correct"
    (tmp_path / "e.tsv").write_text("\t".join(head.split()) + "\n" + "\t".join(["1", "bank", "NN", "0,4", "1", "1", "", "", "bank x", "True"]) + "\n")
    r = readers.evaluated(spark, str(tmp_path / "e.tsv")).collect()
    assert [(x["context_id"], x["correct"]) for x in r] == [("1", True)]
