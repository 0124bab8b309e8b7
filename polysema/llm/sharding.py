"""Sharding by weighted rendezvous hashing. DataFrame functions only.

Every (record key, shard) pair draws a uniform number u from a hash; the shard
with the smallest ``-ln(u) / weight`` owns the record. Adding a shard can only
move a record into the new shard, since the draws of the others stay the same.

Defined results
* a null key counts as the empty key; null text has no bytes (size 1, crc 0);
* repeated rows go to the same shard and get a slot each;
* equal draws go to the smaller shard number;
* an empty table gives an empty table; columns other than the key and the text
  are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are dealt within (shard, bucket); 4096 buckets a shard keep a window
#: partition near 3 million rows at 100 billion records over 8 shards.
BUCKETS = 4096
#: Equal rows are expanded from one counted row in runs of this many.
RUN = 1 << 20


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide: 52 bits of an MD5."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def owner(key: Column, weights: list[float]) -> Column:
    """Number of the shard that owns the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    costs = [F.struct((-F.log(draw(key, s)) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*costs))["shard"]


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def assign(df: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """The input with the owning shard added, no shuffle."""
    return df.withColumn(name, owner(key_text(F.col(key)), weights))


def manifest(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, weights: list[float] | None = None) -> DataFrame:
    """One row a record: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless from 0 within a shard. Equal rows are counted first (with
    a partial aggregate, so a hot row shuffles as one row a task), prefix sums
    over (shard, bucket) give where a bucket begins, and a window within the
    bucket gives the rest; no task holds a whole shard.
    """
    weights = weights or [1.0] * shards
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    k = key_text(F.col("doc_id"))
    spread = F.concat_ws(":", k, F.col("size"), F.col("text_crc32"))
    dealt = same.select(
        "*",
        owner(k, weights).alias("shard"),
        owner(k, grown).alias("grown_shard"),
        F.conv(F.substring(F.md5(spread), 1, 3), 16, 10).cast("int").alias("bucket"),
    )
    sums = dealt.groupBy("shard", "bucket").agg(F.sum("n").alias("bucket_n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x BUCKETS rows: the broadcast does not grow with the records
    starts = F.broadcast(sums.select("shard", "bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("bucket_at")))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, ["shard", "bucket"]).withColumn("at", F.col("bucket_at") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("run"), F.least(F.col("n") - 1, F.col("run") + RUN - 1))))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("i")).alias("slot"), "grown_shard")


def _draw_sql(key: str, shard: int) -> str:
    return f"((('0x' || substr(md5({key} || ':{shard}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(1 << 52)}"


def _owner_sql(key: str, weights: list[float]) -> str:
    cost = lambda s, w: f"(-ln({_draw_sql(key, s)}) / {float(w)})"
    return "list_min([" + ", ".join(f"{{'cost': {cost(s, w)}, 'shard': {s}}}" for s, w in enumerate(weights)) + "]).shard"


#: Whole-text CRC-32 by a 256-entry table made in SQL, folded over the bytes.
ORACLE_SQL = f"""
with recursive bits(i, c, k) as (
  select i, i::UBIGINT, 0 from range(256) r(i)
  union all
  select i, case when c & 1 = 1 then xor(3988292384::UBIGINT, c >> 1) else c >> 1 end, k + 1 from bits where k < 8
), crc_table as (
  select list(c order by i) as t from bits where k = 8
), rows as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda a, b: xor(t[((xor(a, b) & 255) + 1)::BIGINT], a >> 8)), 4294967295::UBIGINT)::BIGINT as text_crc32
  from documents, crc_table
), dealt as (
  select *, coalesce(doc_id::VARCHAR, '') as k from rows
), placed as (
  select *, {_owner_sql("k", [1.0] * 8)} as shard, {_owner_sql("k", [1.0] * 9)} as grown_shard,
    ('0x' || substr(md5(k || ':' || size || ':' || text_crc32), 1, 3))::INT as bucket
  from dealt
)
select doc_id, size::BIGINT as size, text_crc32, 'key' as law, shard::INT as shard,
  (row_number() over (partition by shard order by bucket, doc_id nulls first, size, text_crc32) - 1)::BIGINT as slot,
  grown_shard::INT as grown_shard
from placed
"""
