"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.tables import Scratch

#: Parts into which a key's rows are dealt.
SALT = 16


def salted_join(rows: DataFrame, few: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join with a table that has a row for each key at most: each key's rows are dealt into
    SALT parts by a hash of the column ``by``, so that no key is one task."""
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    copies = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(copies, [on, "salt_"]).drop("salt_")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (bigint). node, root for every node of a link; the root is the component's smallest node.

    In each round a node takes the smallest label among itself and its neighbours and
    then that label's own label. Rounds are written to the shared folder; neighbours
    are reduced by a minimum, so a node with very many links is no hot task there, and
    the join on a hot node reads plain tables, so that its partition can be split.
    """
    both = edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, "links")
    kept = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        labels = kept.select("node", "root")
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("root").alias("near"))
        next_label = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        roots = next_label.select("root").distinct().join(labels.select(F.col("node").alias("via"), F.col("root").alias("further")), F.col("root") == F.col("via")).select("root", "further")
        jumped = salted_join(next_label, roots, "root", "node").select("node", "was", F.least("root", "further").alias("root"))
        done, kept = kept, scratch.keep(jumped, "labels")
        changed = not kept.where("root <> was").isEmpty()
        scratch.drop(done)
        if not changed:
            scratch.drop(both)
            return scratch.named(kept.select("node", "root"), kept)
