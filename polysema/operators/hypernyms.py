"""Hypernym relations, labels of clusters, disambiguated cluster members, synset links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysema.functions import text as X


def relations(rows: DataFrame, min_freq: float = 0, lemmas: DataFrame | None = None) -> DataFrame:
    """rows: hyponym, hypernym, freq. hypo, hyper, freq: cleaned, lower case, without #marks, frequencies summed;
    with lemmas (word, lemma) the lemma pair is added where it differs."""
    clean = lambda c: F.lower(F.substring_index(X.csv_clean(F.col(c)), "#", 1))
    base = rows.where(F.col("freq") >= min_freq).select(clean("hyponym").alias("hypo"), clean("hypernym").alias("hyper"), "freq")
    if lemmas is not None:
        a, b = lemmas.select(F.col("word").alias("hypo"), F.col("lemma").alias("la")), lemmas.select(F.col("word").alias("hyper"), F.col("lemma").alias("lb"))
        l = base.join(a, "hypo", "left").join(b, "hyper", "left").select("hypo", "hyper", "freq", F.coalesce("la", "hypo").alias("la"), F.coalesce("lb", "hyper").alias("lb"))  # noqa: E741
        base = base.unionAll(l.where("la <> hypo or lb <> hyper").select("la", "lb", "freq"))
    return base.groupBy("hypo", "hyper").agg(F.sum("freq").alias("freq"))


def hypernyms_of(words: DataFrame, isa: DataFrame, most: int = 1000) -> DataFrame:
    """words: word. word, hyper, freq, rank, the word itself left out; a word that has none is looked up in lower case."""
    keys = words.select("word", F.posexplode(F.array_distinct(F.array("word", F.lower("word")))).alias("way", "hypo")).join(isa, "hypo")
    first = keys.withColumn("f", F.min("way").over(Window.partitionBy("word"))).where("way = f and hyper <> word")
    return first.select("word", "hyper", "freq", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("freq"), "hyper")).alias("rank")).where(F.col("rank") <= most)


def hyponyms_of(words: DataFrame, isa: DataFrame, most: int = 1000) -> DataFrame:
    found = words.select("word").join(isa.withColumnRenamed("hyper", "word"), "word").where("hypo <> word")
    return found.select("word", "hypo", "freq", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("freq"), "hypo")).alias("rank")).where(F.col("rank") <= most)


def has_relation(pairs: DataFrame, isa: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """pairs: hypo, hyper. The largest frequency over raw and lower-case forms (and lemmas) of both, else 0."""
    forms = pairs
    for c in ("hypo", "hyper"):
        if lemmas is not None:
            forms = forms.join(lemmas.select(F.col("word").alias(c), F.col("lemma").alias(f"l_{c}")), c, "left")
        lemma = F.coalesce(f"l_{c}", c) if lemmas is not None else F.col(c)
        forms = forms.withColumn(f"v_{c}", F.array_distinct(F.array(F.col(c), F.lower(c), lemma, F.lower(lemma))))
    each = forms.select("hypo", "hyper", F.explode("v_hypo").alias("a"), "v_hyper").select("hypo", "hyper", "a", F.explode("v_hyper").alias("b"))
    known = isa.select(F.col("hypo").alias("a"), F.col("hyper").alias("b"), "freq")
    return each.join(known, ["a", "b"], "left").groupBy("hypo", "hyper").agg(F.coalesce(F.max("freq"), F.lit(0)).alias("freq"))


def labels(clusters: DataFrame, isa: DataFrame, most: int = 5) -> DataFrame:
    """word, cid, hyper, score, score_share, n, n_share, rank: hypernyms of the members by sum of similarity times
    frequency; forms of the word itself are left out."""
    found = clusters.select("word", "cid", "size", X.norm(F.col("member")).alias("hypo"), "sim").join(isa, "hypo")
    other = found.where((F.col("hyper") != F.col("word")) & (F.col("hyper") != F.lower("word")) & (F.col("hyper") != X.capitalised(F.col("word"))))
    total = other.groupBy("word", "cid", "size", "hyper").agg(F.round(F.sum(F.col("sim") * F.col("freq")), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("word", "cid").orderBy(F.desc("score"), "hyper"))).where(F.col("rank") <= most)
    return ranked.select("word", "cid", "hyper", "score", F.round(F.col("score") / F.col("size"), 6).alias("score_share"), "n", F.round(F.col("n") / F.col("size"), 6).alias("n_share"), "rank")


def head_hypernym(terms: DataFrame) -> DataFrame:
    """terms: term, tokens array<struct<text, pos, entity>> (see ``morphology.tagged``). term, hyper, score.

    For terms of several words longer than six characters without a named entity: what stands before the last adposition, if its last
    word is a noun; without an adposition the last word, if it is one. The score is the share of the term's length."""
    t = F.col("tokens")
    at = F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), F.lit(-1), lambda a, i: F.when(F.get(t, i)["pos"] == "ADP", i).otherwise(a))
    fit = terms.where((F.length("term") > 6) & F.col("term").contains(" ") & (F.size(t) > 0) & ~F.exists(t, lambda x: x["entity"])).withColumn("at", at)
    head = F.when(F.col("at") > 0, F.get(t, F.col("at") - 1)).otherwise(F.element_at(t, -1))
    hyper = F.when(F.col("at") > 0, F.array_join(F.transform(F.slice(t, F.lit(1), F.greatest(F.col("at"), F.lit(0))), lambda x: x["text"]), " ")).otherwise(F.element_at(t, -1)["text"])
    return fit.where(head["pos"] == "NOUN").select("term", hyper.alias("hyper")).withColumn("score", F.length("hyper") / F.length("term"))


def with_heads(labelled: DataFrame, clusters: DataFrame, heads: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """word, cid, hyper, score, source (cluster or head): the labels of ``labels`` and, of words that are terms with a head
    (term, hyper, score), that head as one more hypernym of each of their senses, unless it is a label already.

    lemmas: word, lemma. Labels whose lemma is the word itself in lower case are left out."""
    kept = labelled.select("word", "cid", "hyper", "score")
    if lemmas is not None:
        of = lemmas.select(F.col("word").alias("hyper"), "lemma")
        kept = kept.join(of, "hyper", "left").where(F.coalesce("lemma", "hyper") != F.lower("word")).select("word", "cid", "hyper", "score")
    senses = clusters.select("word", "cid").distinct()
    own = senses.join(heads.select(F.col("term").alias("word"), "hyper", F.round("score", 6).alias("score")), "word").select("word", "cid", "hyper", "score")
    more = own.join(labelled.select("word", "cid", "hyper"), ["word", "cid", "hyper"], "left_anti")
    return kept.withColumn("source", F.lit("cluster")).unionByName(more.withColumn("source", F.lit("head")))


def disambiguated_members(clusters: DataFrame, context: DataFrame | None = None, least: float = 1e-6) -> DataFrame:
    """word, cid, member, sense, score: of each member the sense (``member#cid``) whose cluster is most similar to
    the context of the member; ``member#?`` below the limit.

    The context is the sense's own cluster (or the given one: word, cid, member, sim) without the member's forms,
    and the head word with weight 1. Both are sparse vectors: they meet on their features only."""
    source = context if context is not None else clusters
    base = source.select("word", "cid", X.norm(F.col("member")).alias("f"), "sim").groupBy("word", "cid", "f").agg(F.max("sim").alias("w"))
    head = clusters.select("word", "cid").distinct().select("word", "cid", X.norm(F.col("word")).alias("f"), F.lit(1.0).alias("w"))
    ctx = base.unionAll(head).groupBy("word", "cid", "f").agg(F.max("w").alias("w"))
    members = clusters.select("word", "cid", "member").distinct()
    of_member = members.join(ctx, ["word", "cid"]).where(F.col("f") != X.norm(F.col("member")))
    norm_c = of_member.groupBy("word", "cid", "member").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nc"))
    cand = clusters.select(F.col("word").alias("s_word"), F.col("cid").alias("s_cid"), X.norm(F.col("member")).alias("f"), F.col("sim").alias("sw"))
    norm_s = cand.groupBy("s_word", "s_cid").agg(F.sqrt(F.sum(F.col("sw") * F.col("sw"))).alias("ns"))
    keyed = of_member.withColumn("s_norm", X.norm(F.col("member")))
    dot = keyed.join(cand.withColumn("s_norm", X.norm(F.col("s_word"))), ["s_norm", "f"]).groupBy("word", "cid", "member", "s_word", "s_cid").agg(F.sum(F.col("w") * F.col("sw")).alias("dot"))
    scored = dot.join(norm_c, ["word", "cid", "member"]).join(norm_s, ["s_word", "s_cid"]).select(
        "word", "cid", "member", "s_word", "s_cid", (F.col("s_word") != F.col("member")).alias("loose"), F.round(F.col("dot") / (F.col("nc") * F.col("ns")), 6).alias("score")
    )
    best = scored.groupBy("word", "cid", "member").agg(F.min(F.struct("loose", (-F.col("score")).alias("s"), "s_word", "s_cid")).alias("b"))
    out = members.join(best, ["word", "cid", "member"], "left")
    sure = -F.col("b.s") >= least
    return out.select("word", "cid", "member", F.when(sure, X.sense_id(F.col("b.s_word"), F.col("b.s_cid"))).otherwise(F.concat("member", F.lit("#?"))).alias("sense"), F.when(sure, -F.col("b.s")).otherwise(F.lit(0.0)).alias("score"))


def label_pairs(synsets: DataFrame, most: int = 3) -> DataFrame:
    """synsets: synset (s... and h...), word, rank. hypo, hyper, source: members of a synset s with the first
    members of its hypernym synset h of the same number, different words only."""
    hypo = synsets.where(F.col("synset").startswith("s")).select(F.expr("substring(synset, 2)").alias("id"), F.col("word").alias("hypo"))
    hyper = synsets.where(F.col("synset").startswith("h") & (F.col("rank") <= most)).select(F.expr("substring(synset, 2)").alias("id"), F.col("word").alias("hyper"))
    return hypo.join(hyper, "id").where("hypo <> hyper").select("hypo", "hyper", F.concat(F.lit("label:"), "id").alias("source")).distinct()


def vector_pairs(synsets: DataFrame, near: DataFrame, size_limit: int = 10, max_synsets: int = 1) -> DataFrame:
    """near: src (h...), dst, rank of similar synsets, the ten nearest. hypo, hyper, source: members of h's nearest
    synsets s of limited size, at most max_synsets, as hypernyms of the members of h's own synset s."""
    sizes = synsets.groupBy("synset").agg(F.count(F.lit(1)).alias("size"))
    to = near.where(F.col("src").startswith("h") & F.col("dst").startswith("s") & (F.col("rank") <= 10)).join(sizes.withColumnRenamed("synset", "dst"), "dst").where(F.col("size") <= size_limit)
    kept = to.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("rank", "dst"))).where(F.col("r") <= max_synsets)
    hyper = kept.join(synsets.select(F.col("synset").alias("dst"), F.col("word").alias("hyper")), "dst").select(F.expr("substring(src, 2)").alias("id"), "hyper")
    hypo = synsets.where(F.col("synset").startswith("s")).select(F.expr("substring(synset, 2)").alias("id"), F.col("word").alias("hypo"))
    return hypo.join(hyper, "id").where("hypo <> hyper").select("hypo", "hyper", F.concat(F.lit("vector:"), "id").alias("source")).distinct()


def swept(synsets: DataFrame, near: DataFrame, labels_most: list[int], sizes: list[int], synset_counts: list[int]) -> dict[tuple[int, int, int], DataFrame]:
    """The relations for each setting; the plans share their scans."""
    return {(m, s, c): label_pairs(synsets, m).unionAll(vector_pairs(synsets, near, s, c)) for m in labels_most for s in sizes for c in synset_counts}
