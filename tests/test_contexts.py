"""Contexts that no filter leaves out."""

import numpy as np

from polysema.plans import catalogue


def test_every_target_keeps_its_context(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((40, 4))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    how = {r["ctx_id"]: r["how"] for r in catalogue.queries()["wsd_disambiguate_all"](spark, str(tmp_path)).collect()}
    assert len(how) == 40 and "prior" not in how.values() and any(how[i] == "context" for i in range(3, 40, 7))
