"""Writers of the text formats: plain projections to lines, written in parallel as folders of part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysema.functions import text as X


def _text(df: DataFrame, line: Column, path: str, codec: str | None = None, header: str | None = None) -> None:
    """Lines; a header, where a format has one, is a first line of the first part."""
    lines = df.select(line.alias("value"))
    if header is not None:
        first = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
        lines = first.unionAll(lines)
    lines.write.text(path, compression=codec)


def _table(df: DataFrame, path: str, **columns: Column | str) -> None:
    """Tab-separated columns without quotes; every part file has the header, as readers of folders expect."""
    rows = df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))
    rows.write.csv(path, sep="\t", quote="", escape="", header=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _fields(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *columns)


def word2vec(vectors: DataFrame, path: str, key: str = "word") -> None:
    """The header line ``n d``, then ``word v1 ... vd``."""
    n, d = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    _text(vectors, F.concat_ws(" ", key, F.array_join(F.transform("v", lambda x: x.cast("string")), " ")), path, header=f"{n} {d or 0}")


def inventory(prior: DataFrame, path: str) -> None:
    _text(prior, _fields(X.sense_id(F.col("word"), F.col("cid")), X.fixed_point(F.col("prob"), 6)), path)


def edges(graph: DataFrame, path: str) -> None:
    _text(graph, _fields("src", "dst", X.fixed_point(F.col("weight").cast("double"), 6)), path)


def clusters(senses: DataFrame, path: str, digits: int = 4) -> None:
    """word, cid, cluster array<struct<word, sim, ...>> with empty isas, under a header."""
    _table(senses, path, word="word", cid="cid", cluster=X.format_cluster(F.col("cluster"), digits), isas=F.lit(""))


def keyword_inventory(inv: DataFrame, path: str) -> None:
    _table(inv, path, word="word", cid="cid", keyword="keyword", cluster=F.array_join("cluster", ", "))


def labelled(senses: DataFrame, path: str) -> None:
    """word, cid, cluster, isas (strings) and coverage: five columns under five names."""
    _table(senses, path, word="word", cid="cid", cluster="cluster", isas="isas", coverage="coverage")


def disambiguated(members: DataFrame, path: str, scores: bool = True) -> None:
    """word, cid, sense, score, one row a member, folded to ``word#cid:0.123, ...``."""
    item = F.concat("sense", F.lit(":"), X.fixed_point(F.col("score"), 3)) if scores else F.col("sense")
    one = members.groupBy("word", "cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), item.alias("i")))).alias("c"))
    _table(one, path, word="word", cid="cid", cluster=F.array_join(F.transform("c", lambda x: x["i"]), ", "), isas=F.lit(""))


def closure(closed: DataFrame, path: str) -> None:
    """Kept and filtered senses in the folders kept=true and kept=false of one write."""
    line = _fields("word", F.col("cid").cast("string"), X.format_cluster(F.col("cluster")), F.lit(""))
    closed.select("kept", line.alias("value")).write.partitionBy("kept").text(path)


def relations(pairs: DataFrame, path: str) -> None:
    _text(pairs, _fields("hypo", "hyper", "source"), path)


def sparse_senses(senses: DataFrame, path: str) -> None:
    """word, cid, rank, feature, score folded to ``feature:0.12, ...`` by rank."""
    one = senses.groupBy("word", "cid").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("feature", F.lit(":"), X.fixed_point(F.col("score"), 2)).alias("i")))).alias("f"))
    _table(one, path, word="word", cid="cid", cluster=F.lit(""), isas=F.lit(""), features=F.array_join(F.transform("f", lambda x: x["i"]), ", "))


def predictions(rows: DataFrame, path: str) -> None:
    """All columns as they are, tab-separated without quotes, under a header."""
    rows.write.csv(path, sep="\t", quote="", escape="", header=True, emptyValue="", nullValue="")


def frequencies(freq: DataFrame, path: str) -> None:
    _text(freq.orderBy(F.desc("freq"), "word"), F.concat_ws(" ", "word", F.col("freq").cast("string")), path)


def tokenised(docs: DataFrame, path: str, gzip: bool = True) -> None:
    _text(docs, F.array_join("tokens", " "), path, codec="gzip" if gzip else None)


def pair_similarities(pairs: DataFrame, path: str) -> None:
    _text(pairs, F.concat_ws(",", "w1", "w2", X.fixed_point(F.col("sim"), 6)), path)


def feature_list(vectors: DataFrame, path: str) -> None:
    _text(vectors.select("feature").distinct(), F.col("feature"), path)
