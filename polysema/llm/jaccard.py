"""Self-join of documents by the Jaccard similarity of their word shingles, exact.

Two documents link when 100 * |A and B| >= 75 * |A or B|. Steps:

1. Equal shingle sets (by a 128-bit digest) become one class; only one document
   of each class goes on, named by the number of its row.
2. Stars: classes that share a band of minima are checked against the band's
   smallest class. This joins large groups of near copies by few links, so that
   no later step meets all their pairs. It may miss links; the next steps don't.
3. Keys: of a set of n shingles any n // 4 + 1 hold one of every set that links
   with it, if all sets are ordered alike. The order puts shingles that many
   documents share last (counted by every task over all its rows, then summed),
   so that common passages are no keys. Only keys met by two different
   components go on. The place of a key in both sets bounds what the sets can
   share behind it, which leaves out most pairs at most of their keys.
4. Tiles: the classes of a key are dealt into size bands (a band and the next
   hold all sizes within 3/4) and, if a band is large, into tiles of TILE rows
   or TILE_SHINGLES shingles each way. In a tile, bit counts of hashed bitmap
   signatures bound the overlap from above; what leaves it are the tile's rows
   that have a partner left, never pairs.
5. The sorted shingle arrays of these rows' whole texts come to the tile and are
   intersected exactly there; a tile joins what it finds as it goes, so that at
   most one link a row leaves it. Connected components give the result.

Defined results: null text and text without words has no shingles, links with
nothing and is its own component; repeated rows share a component; rows of one
doc_id with different texts are separate documents; a null id is never the
smallest of a component unless all its ids are null; extra columns are ignored,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.llm.components import connected_components, salted_join
from polysema.llm.memory import begins
from polysema.llm.shingles import linked, shingles
from polysema.tables import Scratch, small

#: Bands of minima; parts into which a star is dealt; rows and shingles of a tile each way.
BANDS, SALT, TILE, TILE_SHINGLES = 8, 16, 1024, 2_000_000
#: Common shingles: documents of a task from which it reports one, documents in all
#: from which it is moved to the end, and how many of them at most (8 bytes each).
#: The bound only touches the order of keys, never the result.
SEEN, COMMON, MOST_COMMON = 3, 16, 500_000
#: Bits of a hash that a task marks, and entries of its counts before the rare ones are put out of them.
MARKS, COUNTED = 24, 1_500_000


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that many documents hold. A task counts a shingle from its second
    document on; the first one is only marked, by a bit of its hash, so that rare shingles take no room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("jaccard")
        marked = np.zeros(1 << MARKS, bool)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            k, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingles(t.as_py()) for t in batch.column(0))]), return_counts=True)
            place = k >> np.uint64(64 - MARKS)
            again = c - ~marked[place]
            marked[place] = True
            k, c = k[again > 0], again[again > 0]
            both = np.concatenate((keys, k))
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate((counts, c))[order]
            first = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.zeros(0, bool)
            keys, counts = both[first], np.add.reduceat(n, np.flatnonzero(first)) if len(both) else n
            if len(keys) > COUNTED:
                keep = counts > max(1, np.partition(counts, -COUNTED // 2)[-COUNTED // 2] - 1)
                keys, counts = keys[keep], counts[keep]
        keep = counts >= SEEN - 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep] + 1)], ["key", "n"])

    found = docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    top = found.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow()
    return np.sort(top.column("key").to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> bytes:
    """A set's signature: one bit a shingle hash, in a power of two of at least 2 n bits."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[s >> np.uint64(20) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def band_keys(s: np.ndarray) -> list[int]:
    """Hashes of pairs of minima; minimum i is over the shingles whose top bits say i."""
    at = np.searchsorted(s, np.arange(2 * BANDS, dtype=np.uint64) << np.uint64(64 - (2 * BANDS - 1).bit_length()))
    low = [int(s[a]) if a < len(s) and int(s[a]) >> (64 - (2 * BANDS - 1).bit_length()) == i else 0 for i, a in enumerate(at)]
    found = [(i, low[i], low[i + 1]) for i in range(0, 2 * BANDS, 2) if low[i] or low[i + 1]]
    return [int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little", signed=True) for x in found]


_SETS = "doc_id bigint, text_hash bigint, d1 bigint, d2 bigint, n bigint, bands array<bigint>, keys array<bigint>, bitmap binary"


def sets(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """docs: doc_id, text_hash, text. One row a document: its digest, size, bands, keys in their order, and signature."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # MOST_COMMON numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("jaccard")
        common = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column(2):
                s = shingles(t.as_py())
                if not len(s):
                    row = None, None, 0, [], [], b""
                else:
                    d1, d2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                    need = len(s) // 4 + 1
                    if len(common):
                        at = np.searchsorted(common, s)
                        at[at == len(common)] = 0
                        many = common[at] == s
                        s_ordered = np.concatenate((s[~many], s[many])) if many.any() else s
                    else:
                        s_ordered = s
                    row = int(d1), int(d2), len(s), band_keys(s), s_ordered[:need].view(np.int64), bitmap(s)
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [x.split()[0] for x in _SETS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return docs.mapInArrow(run, _SETS)


def located(docs: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The texts of the wanted documents (doc_id, text_hash and the columns), one row for each row of ``wanted``
    and each of the document's copies."""
    d, w = docs.alias("d"), small(wanted).alias("w")
    return d.join(w, (F.col("d.text_hash") == F.col("w.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select(*(f"w.{c}" for c in columns), "d.text")


def verified(links: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The links (a, b) whose shingle sets reach the threshold.

    The whole texts of b travel to their a, of which every star has SALT copies, so no star is one task."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    ends = dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node")).unionAll(dealt.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node")))
    wanted = scratch.keep(ends.join(classes.select("node", "doc_id", "text_hash"), "node"), "wanted")
    rows = located(docs, wanted, "a", "salt", "role", "node")
    sorted_rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("jaccard")
        star, centre = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, role, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if role == 0:
                    if star != (a, salt):
                        star, centre = (a, salt), shingles(text.as_py())
                elif star == (a, salt) and linked(centre, shingles(text.as_py())):
                    a_out.append(a)
                    b_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    kept = scratch.keep(sorted_rows.mapInArrow(run, "a bigint, b bigint"), "verified")
    scratch.drop(wanted)
    return kept


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """A signature (64-bit words) as one of fewer bits."""
    return np.bitwise_or.reduce(signature.reshape(-1, words), axis=0)


class Tile:
    """Rows of one tile in order of size: class, size, place of the key in the class's order, component, whether
    the tile is the class's own band, and the part of the band."""

    def __init__(self, node: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, own: np.ndarray, sub: np.ndarray):
        self.node, self.n, self.comp, self.own, self.sub = node, n, comp, own, sub
        self.left = n - pos
        self.across = sub.min() != sub.max()
        self.end = np.searchsorted(3 * n, 4 * n, side="right")  # behind the largest partner of each row

    def partners(self, i: int, comp: np.ndarray) -> np.ndarray:
        """Rows behind i that may link with it, as far as sizes, places, parts and components tell. A pair stands in
        the tile of the smaller band; in a tile between two parts of a band, only pairs of different parts do."""
        j = slice(i + 1, self.end[i])
        ok = (comp[j] != comp[i]) & (self.own[j] | self.own[i]) & (7 * np.minimum(self.left[j], self.left[i]) >= 3 * (self.n[j] + self.n[i]))
        if self.across:
            ok &= self.sub[j] != self.sub[i]
        return np.flatnonzero(ok) + i + 1


def survivors(tile: Tile, signatures: list[bytes]) -> np.ndarray:
    """Whether a row has a partner within the signatures' bound."""
    words = [np.frombuffer(b, "<u8") for b in signatures]
    width = min(map(len, words))
    bits = np.stack([folded(w, width) for w in words])
    n, alive = tile.n, np.zeros(len(tile.n), bool)
    for i in range(len(n) - 1):
        at = tile.partners(i, tile.comp)
        if alive[i]:
            at = at[~alive[at]]
        if len(at):
            a, b = bits[i], bits[at]
            bound = np.minimum(n[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n[at] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
            may = at[7 * bound >= 3 * (n[i] + n[at])]
            alive[may] = True
            alive[i] |= len(may) > 0
    return alive


def links(tile: Tile, arrays: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the components of a tile, as many as join what belongs together."""
    sizes = np.array([len(a) for a in arrays])
    start = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.unique(np.concatenate(arrays), return_inverse=True)[1]
    mark, comp, out = np.zeros(len(ids), np.int64), tile.comp.copy(), []
    for i in range(len(sizes) - 1):
        at = tile.partners(i, comp)
        if not len(at):
            continue
        own = ids[start[i] : start[i + 1]]
        mark[own] = 1
        low, high = at[0], at[-1] + 1
        if 4 * len(at) > high - low:
            both = np.add.reduceat(mark[ids[start[low] : start[high]]], start[low:high] - start[low])[at - low]
        else:
            both = np.array([mark[ids[start[k] : start[k + 1]]].sum() for k in at])
        mark[own] = 0
        for k in at[100 * both >= 75 * (sizes[i] + sizes[at] - both)]:
            if comp[k] != comp[i]:
                out.append((int(tile.node[i]), int(tile.node[k])))
                comp[comp == comp[k]] = comp[i]
    return out


_TILE = ["key", "tile", "i", "j"]
_ROW = ["node", "n", "pos", "comp", "own", "sub"]


def by_tile(rows: DataFrame, found: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Maps every tile by ``found``; a task holds one tile at a time. rows: _TILE, _ROW and one more column."""
    rows = rows.select(*_TILE, *_ROW, rows.columns[-1]).repartition(*_TILE).sortWithinPartitions(*_TILE, "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("jaccard")
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy() for c in range(4)]
            new = np.logical_or.reduce([x[1:] != x[:-1] for x in k])
            cut = np.concatenate(([0], np.flatnonzero(new) + 1, [batch.num_rows]))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                this = tuple(int(x[s]) for x in k)
                if this != last and held:
                    table = pa.Table.from_batches(held)
                    if table.num_rows > 1:
                        yield found(table)
                    held = []
                held.append(batch.slice(s, e - s))
                last = this
        if held and (table := pa.Table.from_batches(held)).num_rows > 1:
            yield found(table)

    return rows.mapInArrow(run, schema)


def _tile(table: pa.Table) -> Tile:
    return Tile(*(table.column(c).to_numpy() for c in _ROW))


def _survive(table: pa.Table) -> pa.RecordBatch:
    own = table.select([*_TILE, *_ROW])
    alive = survivors(_tile(table), table.column("bitmap").to_pylist())
    return own.filter(pa.array(alive)).combine_chunks().to_batches()[0] if alive.any() else pa.RecordBatch.from_pylist([], own.schema)


def _link(table: pa.Table) -> pa.RecordBatch:
    found = links(_tile(table), [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()])
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def shingle_arrays(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, shingles (sorted, 8 bytes each) of classes (node, doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("jaccard")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["node", "shingles"])

    return located(docs, classes, "node").mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"])


def tile_links(members: DataFrame, reps: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """members: key, node, n, pos, comp. reps: node, bitmap. Links (a, b) between components, enough to join what belongs together."""
    h = F.xxhash64("node")
    sums = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(h, 32)).alias("high"), F.min(F.struct("node", "pos")).alias("at"), F.max(F.col("pos") * 7 <= F.col("n")).alias("early")
    )
    # of keys with the same classes the first in the order stands for all
    keys = scratch.keep(sums.groupBy("c", "low", "high").agg(F.min_by("key", "at.pos").alias("key"), F.max("early").alias("early")).where("early").select("key"), "keys")
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    placed = members.join(small(keys), "key").withColumn("band", band).withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn("own", F.col("tile") == F.col("band"))
    placed = scratch.keep(placed.drop("band"), "placed")
    parts = placed.groupBy("key", "tile").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("own").alias("any_own"), F.max(F.col("pos") * 7 <= F.col("n")).alias("early"))
    parts = parts.where("c0 <> c1 and any_own and early").select("key", "tile", F.greatest(F.ceil(F.col("rows") / TILE), F.ceil(F.col("size") / TILE_SHINGLES)).cast("int").alias("parts"))
    parts = scratch.keep(parts, "tiles")
    dealt = placed.join(small(parts), ["key", "tile"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    crossed = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns({"i": F.least("sub", "other"), "j": F.greatest("sub", "other")}).select(*_TILE, *_ROW)
    used = scratch.keep(crossed.select("node").distinct(), "used")
    signed = crossed.join(reps.select("node", "bitmap").join(small(used), "node", "left_semi"), "node")
    kinds = "key bigint, tile int, i int, j int, node bigint, n bigint, pos int, comp bigint, own boolean, sub int"
    alive = scratch.keep(by_tile(signed, _survive, kinds), "alive")
    wanted = scratch.keep(alive.select("node").distinct().join(classes.select("node", "doc_id", "text_hash"), "node"), "wanted")
    arrays = scratch.keep(shingle_arrays(docs, wanted), "arrays")
    found = scratch.keep(by_tile(alive.join(arrays, "node"), _link, "a bigint, b bigint"), "links")
    for t in (keys, placed, parts, used, alive, wanted, arrays):
        scratch.drop(t)
    return found


def classes_and_rows(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Every row's digest (doc_id, text_hash, d1, d2, n), and every class (d1, d2, the smallest doc_id
    with its text_hash, node, component: the node that names its component, component_id: its smallest doc_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    known = scratch.keep(sets(rows, common_shingles(rows)).withColumn("row", F.monotonically_increasing_id()), "sets")
    full = known.where("n > 0")
    one = full.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r"), F.min("row").alias("node"))
    classes = scratch.keep(one.select("d1", "d2", "node", "r.doc_id", "r.text_hash"), "classes")
    reps = full.join(small(classes.select("node")), F.col("row") == F.col("node"), "left_semi").drop("node").withColumnRenamed("row", "node")

    bands = reps.select("node", "n", F.explode(F.array_distinct("bands")).alias("band"))
    first = bands.groupBy("band").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")).where("first.node <> last").select("band", F.col("first.node").alias("a"), F.col("first.n").alias("n_a"))
    first = scratch.keep(first, "first")
    stars = bands.join(small(first), "band").where("node <> a and 4 * least(n, n_a) >= 3 * greatest(n, n_a)").select("a", F.col("node").alias("b")).distinct()
    star_links = verified(stars, rows, classes, scratch)
    comps = connected_components(star_links, scratch)

    in_comp = reps.select("node", "n", "keys").join(small(comps), "node", "left").withColumn("comp", F.coalesce("root", "node"))
    keyed = in_comp.select("node", "n", "comp", F.posexplode("keys").alias("pos", "key"))
    active = scratch.keep(keyed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key"), "active")
    members = scratch.keep(keyed.join(small(active), "key"), "members")
    found = star_links.unionAll(tile_links(members, reps, rows, classes, scratch))
    roots = connected_components(found, scratch)

    linked_classes = classes.join(roots, "node").select("node", "doc_id", "root")
    smallest = scratch.keep(linked_classes.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    of_node = scratch.keep(salted_join(linked_classes.select("node", "root"), smallest, "root", "node"), "of_node")
    named = classes.join(of_node, "node", "left").select(
        "d1", "d2", "doc_id", "text_hash", "node", F.coalesce("root", "node").alias("component"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    named = scratch.keep(named, "components")
    for t in (classes, first, star_links, comps, active, members, roots, smallest, of_node):
        scratch.drop(t)
    return known.select("doc_id", "text_hash", "d1", "d2", "n"), named


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs: doc_id, text. doc_id, text_hash, n_shingles, component_id and component (a number that
    names it in this result, null without shingles) for every row."""
    known, classes = classes_and_rows(docs, scratch or Scratch(docs.sparkSession, "jaccard"))
    k, c = known.alias("k"), classes.select("d1", "d2", "component", "component_id").alias("c")
    component_id = F.when(F.col("k.n") > 0, F.col("c.component_id")).otherwise(F.col("k.doc_id")).alias("component_id")
    joined = k.join(c, (F.col("k.d1") == F.col("c.d1")) & (F.col("k.d2") == F.col("c.d2")), "left")
    return joined.select("k.doc_id", "k.text_hash", F.col("k.n").alias("n_shingles"), component_id, "c.component")


def one_of_each(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One document of each component, that of the smallest id; same columns. Documents without
    shingles all stay. Repeated rows of a document that stays leave one row."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    known, classes = classes_and_rows(docs.select("doc_id", "text"), scratch)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r")
    stay = scratch.keep(classes.groupBy("component").agg(first).select("r.doc_id", "r.text_hash"), "stay")
    # a document without shingles stays as it is, so only the others' repeated rows are thinned out
    repeated = scratch.keep(known.where("n > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    blank = scratch.keep(known.where("n = 0").select("doc_id", "text_hash").distinct(), "blank")

    def those(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.text_hash"))
        return rows.alias("d").join(small(of).alias("s"), same, how)

    kept = those(docs, stay.unionAll(blank), "left_semi")
    if repeated.isEmpty():
        return kept
    return those(kept, repeated, "left_anti").unionAll(those(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
