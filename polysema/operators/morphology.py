"""Lemmas and parts of speech from a caller's table of tagged tokens.

Lemmas: a known form has its most frequent lemma; an unknown one is changed like the forms that share its
longest known suffix (cut an ending, add another). Tags: a hidden Markov model; forms emit by their counts, unknown forms like
the known ones with the same longest suffix, and the best path is found by Viterbi's algorithm over each term.

All of it is joins and aggregates of the table; suffix tables have a few rows a distinct form. Scores are
thousandths of natural logarithms, as integers, so that sums are exact.

tokens (the caller's table): sentence, place, form, lemma, tag. Forms are compared in lower case. Null forms are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysema.functions import text as X

#: Characters of the longest suffix that is looked at, for lemmas and for tags.
LEMMA_SUFFIX, TAG_SUFFIX = 6, 4
START = "^"


def _suffixes(word: Column, longest: int, shortest: int = 1) -> Column:
    """The word's endings, its whole self included if it is short."""
    sizes = F.sequence(F.lit(shortest), F.least(F.length(word), F.lit(longest)))
    return F.transform(F.when(F.length(word) >= shortest, sizes).otherwise(F.array().cast("array<int>")), lambda n: F.when(n > 0, F.substring(word, F.length(word) - n + 1, n)).otherwise(F.lit("")))


def known_lemmas(tokens: DataFrame) -> DataFrame:
    """form, lemma: the most frequent lemma of each form (ties: the smaller one)."""
    n = tokens.where("form is not null and lemma is not null").groupBy(F.lower("form").alias("form"), F.lower("lemma").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("lemma"))).alias("b")).select("form", F.col("b.lemma").alias("lemma"))


def suffix_rules(known: DataFrame, longest: int = LEMMA_SUFFIX) -> DataFrame:
    """known: form, lemma. suffix, cut (characters), add: for each suffix the change that most forms with it undergo (ties: the shorter cut, then the smaller addition)."""
    shared = F.expr("aggregate(sequence(1, length(form)), 0, (a, i) -> if(a = i - 1 and i <= length(lemma) and substring(form, i, 1) = substring(lemma, i, 1), i, a))")
    change = known.where("form <> ''").withColumn("shared", shared).withColumn("cut", F.length("form") - F.col("shared")).withColumn("add", F.substring(F.col("lemma"), F.col("shared") + 1, F.length("lemma")))
    each = change.select("cut", "add", F.explode(_suffixes(F.col("form"), longest)).alias("suffix")).where(F.length("suffix") >= F.col("cut"))
    n = each.groupBy("suffix", "cut", "add").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("cut"), F.col("add"))).alias("b")).select("suffix", "b.cut", "b.add")


def lemmas(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """words: word. word, lemma, how (known, suffix, or none: the word itself in lower case) of each distinct word."""
    known = known_lemmas(tokens)
    w = words.where("word is not null").select("word").distinct().withColumn("form", F.lower("word"))
    ends = w.select("word", "form", F.explode(_suffixes(F.col("form"), LEMMA_SUFFIX)).alias("suffix")).join(suffix_rules(known), "suffix")
    best = ends.groupBy("word").agg(F.max_by(F.struct("form", "cut", "add"), F.length("suffix")).alias("b"))
    changed = best.select(F.col("word").alias("w_"), F.concat(F.expr("substring(b.form, 1, length(b.form) - b.cut)"), "b.add").alias("changed"))
    both = w.join(known, "form", "left").join(changed, F.col("word") == F.col("w_"), "left")
    how = F.when(F.col("lemma").isNotNull(), "known").when(F.coalesce("changed", F.lit("")) != "", "suffix").otherwise("none")
    return both.select("word", F.coalesce("lemma", F.when(F.col("changed") != "", F.col("changed")), "form").alias("lemma"), how.alias("how"))


def _log(share: Column) -> Column:
    return F.round(1000 * F.ln(share)).cast("int")


def emissions(forms: DataFrame, tokens: DataFrame) -> DataFrame:
    """forms: form (lower case, distinct). form, candidates array<struct<tag, score>>: the tags a form may have."""
    seen = tokens.where("form is not null and tag is not null").select(F.lower("form").alias("form"), "tag")
    total = seen.groupBy("tag").agg(F.count(F.lit(1)).alias("all"))  # a row a tag
    by_form = seen.groupBy("form", "tag").agg(F.count(F.lit(1)).alias("n"))
    by_suffix = by_form.select(F.explode(_suffixes(F.col("form"), TAG_SUFFIX, 0)).alias("suffix"), "tag", "n").groupBy("suffix", "tag").agg(F.sum("n").alias("n"))
    known = forms.join(by_form, "form").select("form", "tag", "n")
    new = forms.join(by_form.select("form").distinct(), "form", "left_anti")
    ends = new.select("form", F.explode(_suffixes(F.col("form"), TAG_SUFFIX, 0)).alias("suffix")).join(by_suffix.select("suffix").distinct(), "suffix")
    longest = ends.groupBy("form").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))
    guessed = longest.join(by_suffix, "suffix").select("form", "tag", "n")
    scored = known.unionAll(guessed).join(F.broadcast(total), "tag").select("form", F.struct("tag", _log(F.col("n") / F.col("all")).alias("score")).alias("c"))
    return scored.groupBy("form").agg(F.sort_array(F.collect_list("c")).alias("candidates"))  # as many as there are tags


def transitions(tokens: DataFrame) -> DataFrame:
    """One row: steps map<string, int> from ``a>b`` to the score of tag b behind tag a (START at the beginning), with one added to each count."""
    seen = tokens.where("form is not null and tag is not null")
    before = F.coalesce(F.lag("tag").over(Window.partitionBy("sentence").orderBy("place")), F.lit(START))
    pairs = seen.select(before.alias("a"), F.col("tag").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    tags = seen.select(F.col("tag").alias("b")).distinct()
    grid = tags.select(F.col("b").alias("a")).unionAll(seen.select(F.lit(START).alias("a")).limit(1)).crossJoin(F.broadcast(tags))  # tags squared
    n = grid.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))
    share = n.withColumn("score", _log((F.col("n") + 1) / (F.sum("n").over(Window.partitionBy("a")) + F.count(F.lit(1)).over(Window.partitionBy("a")))))
    return share.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "a", "b"), "score"))).alias("steps"))


def tagged(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """terms: term. term, tokens array<struct<text, pos, entity>> of each distinct term, split at spaces; entity: a proper noun (PROPN).

    Of paths with equal scores the one with the greatest tags in order of the alphabet is taken. Empty terms have no row."""
    words = terms.where("term is not null").select("term").distinct().select("term", F.posexplode(X.split_space(F.col("term"))).alias("at", "text")).withColumn("form", F.lower("text"))
    each = words.join(emissions(words.select("form").distinct(), tokens), "form")
    rows = each.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("at", "text", "candidates"))).alias("w")).crossJoin(F.broadcast(transitions(tokens)))  # one row
    state = "array<struct<score:int,path:array<string>>>"
    # a step keeps the best path to each tag; the greatest struct has the best score, then the greatest path
    path = F.expr(f"""array_max(aggregate(w, cast(array(named_struct('score', 0, 'path', array('{START}'))) as {state}), (s, x) -> transform(x.candidates, c ->
      array_max(transform(s, p -> named_struct('score', p.score + steps[concat(element_at(p.path, -1), '>', c.tag)] + c.score, 'path', concat(p.path, array(c.tag))))))))""")
    best = rows.select("term", "w", path.alias("best"))
    out = F.transform("w", lambda x, i: F.struct(x["text"].alias("text"), F.element_at(F.col("best.path"), i + 2).alias("pos"), (F.element_at(F.col("best.path"), i + 2) == "PROPN").alias("entity")))
    return best.select("term", out.alias("tokens"))
