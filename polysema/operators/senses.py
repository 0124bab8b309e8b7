"""Sense inventories and sense vectors: priors, pooling, similarity, the model of senses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.functions import vectors as V
from polysema.operators.streams import by_part, stream
from polysema.tables import Scratch, fits

#: Pairs of words of a part at most, parts that there are for parallel work if each has FEWEST pairs, pairs of senses measured at once.
PAIRS, PARTS, FEWEST, AT_ONCE = 1 << 21, 16, 8192, 65536


def priors(clusters: DataFrame) -> DataFrame:
    """word, cid, prob: the share of a sense's cluster in all cluster members of the word."""
    sizes = clusters.select("word", "cid", "size").distinct()
    total = F.sum("size").over(Window.partitionBy("word"))
    return sizes.select("word", "cid", F.when(total > 0, F.col("size") / total).otherwise(F.lit(1.0)).alias("prob"))


def prior_of(asked: DataFrame, prior: DataFrame) -> DataFrame:
    """asked: word, cid. Its prior, 1 if the sense is unknown."""
    return asked.join(prior, ["word", "cid"], "left").withColumn("prob", F.coalesce("prob", F.lit(1.0)))


def weight(kind: str) -> Column:
    """The weight of a cluster member by its similarity or its place (from 1)."""
    return {"score": F.col("sim"), "rank": 1 / F.col("pos"), "ones": F.lit(1.0)}[kind]


def looked_up(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """members: word, cid, member, pos, weight. The keys of their vectors and weights: the member itself, else what stands
    before its #, else that one's parts at underscores that are longer than 3 characters. Each part has the weight
    over the number of all parts, known or not."""
    base = F.substring_index("member", "#", 1)
    parts = F.split(base, "_")
    one = lambda way, key: F.struct(F.lit(way).alias("way"), key.alias("key"), F.lit(1).alias("over"))
    keys = F.concat(F.array(one(0, F.col("member")), one(1, base)), F.transform(F.filter(parts, lambda p: F.length(p) > 3), lambda p: F.struct(F.lit(2).alias("way"), p.alias("key"), F.size(parts).alias("over"))))
    asked = members.withColumn("k", F.explode(keys)).select("*", "k.way", "k.key", "k.over").drop("k")
    # which key counts is settled before any vector is fetched
    known = asked.join(_held(vectors.select(F.col("word").alias("key")), 64), "key", "left_semi")
    best = known.withColumn("first", F.min("way").over(Window.partitionBy("word", "cid", "member", "pos"))).where("way = first")
    return best.select("word", "cid", "member", "pos", (F.col("weight") / F.col("over")).alias("weight"), "key")


def _held(df: DataFrame, extra: int) -> DataFrame:
    """Marked for broadcast if it is within the budget; extra: bytes of a row beside its columns."""
    return F.broadcast(df) if fits(df, extra) else df


def with_vectors(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """found: word, cid, key, more. The same with the key's v. Vectors that can be broadcast are not shuffled: the rows of a sense are
    together before they get theirs."""
    v = vectors.select(F.col("word").alias("key"), "v")
    size = (v.select(F.max(F.size("v"))).first()[0] or 0) * 8 + 64
    rows = found.repartition("word", "cid").join(_held(v, size), "key")
    return rows.withColumn("v", V.doubles(F.col("v")))


def pooled(clusters: DataFrame, vectors: DataFrame, kind: str = "score", most: int = 20, normalised: bool = True, fallback: bool = True) -> DataFrame:
    """word, cid, v: weighted sums of the vectors of the first members (unknown ones count for the limit), over a normaliser.

    The normaliser is the sum of the weights over the first members for score, their number
    for ones and the sum of their places for rank (as the model of this domain has it; cosines
    don't depend on it), 1 if that is not positive. The limit is applied before the
    vectors are fetched, and a sense gathers `most` vectors at most."""
    first = clusters.where(F.col("pos") <= most).withColumn("weight", weight(kind))
    share = {"score": F.sum("sim"), "ones": F.count(F.lit(1)).cast("double"), "rank": F.sum("pos").cast("double")}[kind]
    total = first.groupBy("word", "cid").agg(share.alias("total"))
    if fallback:
        found = looked_up(first.select("word", "cid", "member", "pos", "weight"), vectors)
    else:
        found = first.withColumn("key", F.col("member"))
    rows = with_vectors(found, vectors).groupBy("word", "cid").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "weight", "v"))).alias("rows"))
    scale = F.when(F.col("total") > 0, 1 / F.col("total")).otherwise(F.lit(1.0)) if normalised else F.lit(1.0)
    return rows.join(total, ["word", "cid"]).select("word", "cid", V.scaled(V.weighted_sum(F.col("rows")), scale).alias("v"))


def vector_or_zero(asked: DataFrame, senses: DataFrame, size: int) -> DataFrame:
    """asked: word, cid. Its vector v, zeros if the sense is unknown."""
    zero = F.array_repeat(F.lit(0.0), size)
    return asked.join(senses.select("word", "cid", "v"), ["word", "cid"], "left").withColumn("v", F.coalesce("v", zero))


def with_word(senses: DataFrame, vectors: DataFrame, share: float = 0.5) -> DataFrame:
    """Sense vectors mixed with their words' vectors, where known."""
    w = vectors.select("word", V.doubles(F.col("v")).alias("wv"))
    return senses.join(w, "word", "left").select("word", "cid", V.mixed(F.col("v"), F.col("wv"), share).alias("v"))


def inventory(prior: DataFrame, senses: DataFrame) -> DataFrame:
    """word, cid, prob, v of the senses that have a vector; both sides' words with underscores for spaces."""
    under = F.translate("word", " ", "_").alias("word")
    return prior.select(under, "cid", "prob").join(senses.select(under, "cid", "v"), ["word", "cid"])


def senses_of(words: DataFrame, inv: DataFrame, ignore_case: bool = False) -> DataFrame:
    """words: word. asked, word, cid, prob, v of its senses, with case variants if so wanted."""
    forms = words.select(F.col("word").alias("asked"), F.explode(X.case_variants(F.translate("word", " ", "_")) if ignore_case else F.array(F.translate("word", " ", "_"))).alias("word"))
    return forms.join(inv, "word")


def most_probable(inv: DataFrame) -> DataFrame:
    """word, cid, prob: the most probable sense (ties: smaller id)."""
    best = F.min(F.struct((-F.col("prob")).alias("p"), F.col("cid")))
    return inv.groupBy("word").agg(best.alias("b")).select("word", F.col("b.cid").alias("cid"), (-F.col("b.p")).alias("prob"))


def max_pairwise(pairs: DataFrame, inv: DataFrame, digits: int = 6) -> DataFrame:
    """pairs: w1, w2. The largest cosine over their senses, 0 where a word has none.

    The pairs are dealt into parts, and each part gets the senses of its words once, not once a pair."""
    if len(pairs.columns) > 2:  # further columns stay
        best = max_pairwise(pairs.select("w1", "w2").distinct(), inv, digits)
        return pairs.join(best, ["w1", "w2"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    scratch = Scratch(pairs.sparkSession, "pairwise")
    pairs = scratch.keep(pairs.select("w1", "w2"), "pairs")
    n = pairs.count()
    parts = max(-(-n // PAIRS), min(PARTS, -(-n // FEWEST)), 1)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("w1"), F.lit(parts)).cast("int"))
    unit = inv.select("word", V.normalise(F.col("v")).alias("v"))
    words = dealt.select("part", F.explode(F.array("w1", "w2")).alias("word")).distinct()
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("w1", "w2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine, passing in by_part(batches):
            held = pa.Table.from_batches(list(mine)).combine_chunks()
            held = held.take(pa.compute.sort_indices(held.column("word")))
            names, start = np.unique(np.asarray(held.column("word").combine_chunks().dictionary_encode().indices), return_index=True)
            known = held.column("word").take(pa.array(start)).combine_chunks()
            flat = held.column("v").combine_chunks()
            v = np.asarray(flat.flatten()).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
            count = np.diff(np.append(start, held.num_rows))
            for block in passing:
                sim = np.zeros(block.num_rows)
                i, j = (np.asarray(pa.compute.fill_null(pa.compute.index_in(block.column(c), known), -1)) for c in ("w1", "w2"))
                both = np.flatnonzero((i >= 0) & (j >= 0))
                many = count[i[both]] * count[j[both]]
                cuts = np.flatnonzero(np.diff(np.concatenate(([-1], np.cumsum(many) // AT_ONCE))))
                for s, e in zip(cuts, [*cuts[1:], len(both)]):
                    row, n = both[s:e], many[s:e]
                    first = np.concatenate(([0], np.cumsum(n)[:-1]))
                    which = np.repeat(np.arange(len(row)), n)
                    k = np.arange(len(which)) - first[which]
                    a, b = start[i[row]][which] + k // count[j[row]][which], start[j[row]][which] + k % count[j[row]][which]
                    dots = np.round(np.einsum("ij,ij->i", v[a], v[b]), digits) + 0.0
                    sim[row] = np.maximum.reduceat(dots, first)
                yield pa.RecordBatch.from_arrays([block.column(0).combine_chunks(), block.column(1).combine_chunks(), pa.array(sim)], ["w1", "w2", "sim"])

    left = words.join(unit, "word").select("part", "word", "v")
    return stream(left, dealt.select("part", "w1", "w2"), []).mapInArrow(run, f"w1 {kinds[0]}, w2 {kinds[1]}, sim double")


def nearest_senses(senses: DataFrame, n: int) -> DataFrame:
    """src, dst, weight over sense ids ``word#cid``."""
    from polysema.operators.graph import nearest_words

    ids = Scratch(senses.sparkSession, "senses").keep(senses.select(X.sense_id(F.col("word"), F.col("cid")).alias("word"), "v"))
    return nearest_words(ids, n)  # the search counts its rows and reads them twice


def similar_words(clusters: DataFrame, n: int, strip_ids: bool = False) -> DataFrame:
    """word, member, sim, rank: members of all senses of a word, equal ones added up."""
    member = X.norm(F.col("member")) if strip_ids else F.col("member")
    total = clusters.select("word", member.alias("member"), "sim").groupBy("word", "member").agg(F.round(F.sum("sim"), 6).alias("sim"))
    w = Window.partitionBy("word").orderBy(F.desc("sim"), "member")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def words_of_norm(clusters: DataFrame) -> DataFrame:
    return clusters.select(X.norm(F.col("word")).alias("norm"), "word").distinct()


def likely_senses(prior: DataFrame, min_prob: float) -> DataFrame:
    """Senses of good tokens with a prior above the limit."""
    return prior.where(F.col("prob") > min_prob).where(X.good_token(F.col("word")))


def cluster_of(asked: DataFrame, clusters: DataFrame) -> DataFrame:
    """asked: word, cid (of any type). word, cid, member, sim of the members of these senses; a sense that isn't there comes once without a member."""
    rows = clusters.select("word", F.col("cid").cast("string").alias("id_"), "member", "sim")
    return asked.withColumn("id_", F.col("cid").cast("string")).join(rows, ["word", "id_"], "left").select("word", "cid", "member", "sim")


def senses_full(words: DataFrame, folded: DataFrame, prior: DataFrame, min_prob: float = 0.0) -> DataFrame:
    """words: word. folded: word, cid, cluster (array). prior: word, cid, prob. word, cid, prob, cluster of the words' senses above a prior, with the good tokens of each cluster."""
    rows = words.select("word").distinct().join(folded, "word").join(prior.select("word", "cid", "prob"), ["word", "cid"]).where(F.col("prob") > min_prob)
    return rows.select("word", "cid", "prob", F.filter("cluster", lambda x: X.good_token(x["word"])).alias("cluster"))


def number_of_senses(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.countDistinct("word", "cid").alias("senses"))
