"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, and the groups they form.

1. Rows are scanned for the sizes and digests of their sets; equal sets are one class from then on.
2. A class whose sets' rarest shingles, those of no other class, are more than a partner may lack has no partner. Shingles
   of a part of the hash space are enough to see that for most classes; they are counted in buckets of hashes.
3. The other classes' sets are made once more. Of each, the shingles that it shares, rarest first, beyond what a partner may
   lack: two linked classes have one of these in common. Classes that hang together by them are candidates of each other.
4. Candidates meet in tiles: a group's classes of a band of sizes, in blocks of a bounded number and size. Bitmaps of hashed
   shingles bound overlaps from above by their bit counts; what is left is intersected. Each two blocks of a band, and of a
   band and the next one, meet in one tile; tiles give sums of links for each class, never pairs.

Words, shingles and sets are told apart by 64-bit hashes that are not linear in their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import checkpointed, fresh, read, small_batches, spread_join, uneven_join
from phonolake.llm.components import components
from phonolake.llm.encoding import slices
from phonolake.llm.shingles import shingle_sets

#: Sets below WHOLE are counted with all their shingles, larger ones with those in the first PART of the hash space.
WHOLE, PART = 64, 0.32
#: Shingles in a bucket; classes in a block, and bytes of their sets.
BUCKET, TILE, TILE_BYTES = 250_000, 1024, 8 << 20
#: Bits of a bitmap for each shingle of the largest set of a tile, as far as a tile's bitmaps take no more bytes than MAPS.
BITS, MAPS = 4, 16 << 20


def class_of(s: np.ndarray) -> int:
    """A digest of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def lack(n, pct: int):
    """How many of its n shingles a linked partner may lack."""
    return n - (n * pct + 99) // 100


def counted(s: np.ndarray, most: float) -> np.ndarray:
    """The shingles of a set that are counted, if sets below most are counted whole."""
    return s if len(s) < most else s[: np.searchsorted(s, np.uint64(int(PART * 2**64)))]


def classes(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) -> (id, n, class, u): size and digest of each row's set, and how many of its shingles are counted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            columns = [batch.column("id"), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [class_of(s) for s in sets], [len(counted(s, WHOLE)) for s in sets]))]
            yield pa.record_batch(columns, names=["id", "n", "class", "u"])

    return docs.mapInArrow(scan, "id long, n long, class long, u long")


def shared_shingles(sets: Iterator[tuple[list[int], list[np.ndarray]]], buckets: int) -> Iterator[pa.RecordBatch]:
    """For batches of (classes, their shingles): rows of a bucket's shingles and classes.

    What is in two classes of a batch already goes out at once under a bucket below 0, of which there are as many, and for
    the count as one entry of class 0: a shingle that all have comes once from a batch.
    """
    for names, parts in sets:
        own = dict(zip(names, parts, strict=True))  # copies in the batch count once
        own.pop(0, None)
        t = np.concatenate([*own.values(), np.zeros(0, dtype=np.uint64)])
        c = np.repeat(np.array(list(own), dtype=np.int64), [len(x) for x in own.values()])
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])[: len(t)]
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > 1)[group] if len(t) else np.zeros(0, dtype=bool)
        rows = [(-1 - int(c[many][0] % buckets), t[many], c[many])] if many.any() else []
        once = ~many | new
        t, c = t[once], np.where(many, 0, c)[once]
        b = ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # in order, as t is
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])[: len(b)])
        rows += [(int(b[x]), t[x:y], c[x:y]) for x, y in zip(at, [*at[1:], len(b)], strict=True)]
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows]), pa.array([r[2].tobytes() for r in rows])], names=["bucket", "t", "c"])


_BUCKETS = "bucket long, t binary, c binary"


def found_twice(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's rows, the (shingle, class) whose shingle is in two classes or more."""
    t = np.frombuffer(b"".join(rows.column("t").to_pylist()), dtype=np.uint64)
    c = np.frombuffer(b"".join(rows.column("c").to_pylist()), dtype=np.int64)
    if len(t) and rows.column("bucket")[0].as_py() < 0:
        return t, c
    order = np.lexsort((c, t))
    t, c = t[order], c[order]
    first = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])[: len(t)]
    t, c = t[first], c[first]
    group = np.cumsum(np.concatenate([[True], t[1:] != t[:-1]])[: len(t)]) - 1
    size, marked = np.bincount(group), np.bincount(group, weights=c == 0)
    many = ((size > 1) | (marked > 0))[group] & (c != 0)
    return t[many], c[many]


def shared_counts(docs: DataFrame, width: int, pct: int, buckets: int) -> DataFrame:
    """(id, text) -> (class, whole, part): how many counted shingles of a class others have, and of those in the first PART.

    Copies may make it too high. Buckets give a row for each shared shingle of a class, so that their rows are in
    proportion to the texts however many buckets these fill; Spark sums them before they are shuffled.
    """
    most, low = WHOLE * 100 / pct, np.uint64(int(PART * 2**64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            for batch in slices(batches, 4000):
                all_sets = shingle_sets(batch.column("text").to_pylist(), width)
                yield [class_of(s) for s in all_sets], [counted(s, most) for s in all_sets]

        yield from shared_shingles(sets(), buckets)

    def count(rows: pa.Table) -> pa.Table:
        t, c = found_twice(rows)
        # larger sets come with shingles that only smaller ones count: these do not count for them
        return pa.table({"class": c, "low": (t < low).astype(np.int32)})

    rows = docs.mapInArrow(scan, _BUCKETS).groupBy("bucket").applyInArrow(count, "class long, low int")
    return rows.groupBy("class").agg(F.count("*").alias("whole"), F.sum("low").alias("part"))


def shared_rows(sets: DataFrame, buckets: int) -> DataFrame:
    """(class, set) -> (t, class) for each shingle that two classes or more have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shared_shingles(((b.column("class").to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in b.column("set").to_pylist()]) for b in slices(batches, 2000)), buckets)

    def rows(bucket: pa.Table) -> pa.Table:
        t, c = found_twice(bucket)
        return pa.table({"t": t.view(np.int64), "class": c})

    return sets.select("class", "set").mapInArrow(scan, _BUCKETS).groupBy("bucket").applyInArrow(rows, "t long, class long")


class Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def roots(self) -> np.ndarray:
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]
        return self.up


def bitmaps(sets: list[np.ndarray], largest: int) -> np.ndarray:
    """A row of bits for each set."""
    bits = 1 << int(BITS * max(largest, 16) - 1).bit_length()
    while bits > 64 and bits * len(sets) > 8 * MAPS:  # fewer bits bound overlaps less, but rightly
        bits >>= 1
    maps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
    for k, s in enumerate(sets):
        at = (s >> np.uint64(20)) & np.uint64(bits - 1)
        np.bitwise_or.at(maps[k], (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
    return maps.view(np.uint64)


def tile_links(names: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's linked classes: the class, the first that it hangs together with in the tile, and how many rows it is linked with.

    All pairs are compared, if sides are 0, and those of different sides otherwise.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    names, size, copies, side, sets = names[order], size[order], copies[order], side[order], [sets[k] for k in order]
    maps = bitmaps(sets, int(size[-1]))
    ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    # shingles as numbers, without those that one class alone has
    words, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids = np.split(ids, np.cumsum(size)[:-1])
    ids = [x[often[x] > 1] for x in ids]
    mark, most = np.zeros(len(words), dtype=np.uint8), max(1, (1 << 22) // max(1, int(size[-1])))
    forest, sums = Forest(len(sets)), np.zeros(len(sets), dtype=np.int64)
    step = max(1, (1 << 25) // (8 * maps.shape[1]))
    for k in range(len(sets)):
        end = int(np.searchsorted(size, size[k] * 100 // pct, "right"))
        mark[ids[k]] = 1
        for a in range(k + 1, end, step):
            at = np.arange(a, min(end, a + step))
            at = at[(side[at] != side[k]) | (side[at] == 0)]
            if not len(at):
                continue
            need = -(-(size[at] + size[k]) * pct // (100 + pct))
            both = np.bitwise_count(maps[at] & maps[k]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(size[at] - (ones[at] - both), size[k] - (ones[k] - both))
            at, need = at[bound >= need], need[bound >= need]
            for z in range(0, len(at), most):
                some = at[z : z + most]
                parts = [ids[j] for j in some.tolist()]
                total = np.concatenate([[0], np.cumsum(mark[np.concatenate(parts)], dtype=np.int64)])
                ends = np.cumsum([0, *map(len, parts)])
                linked = some[total[ends[1:]] - total[ends[:-1]] >= need[z : z + most]]
                if len(linked):
                    sums[k] += copies[linked].sum()
                    sums[linked] += copies[k]
                    for j in linked[forest.up[linked] != forest.up[k]].tolist():
                        forest.up[forest.root(j)] = forest.root(k)
        mark[ids[k]] = 0
    found = np.flatnonzero(sums)
    return names[found], names[forest.roots()[found]], sums[found]


def links_of(tiles: DataFrame, pct: int) -> DataFrame:
    """Rows of tiles -> (a, b, links): see tile_links. Parts of a tile never meet."""

    def compare(rows: pa.Table) -> pa.Table:
        d = rows.to_pandas()
        found = [tile_links(g["class"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in g["set"]], g["copies"].to_numpy(), g["side"].to_numpy(), pct) for _, g in d.groupby("part", sort=False) if len(g) > 1]
        return pa.table({name: pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(f[k] for f in found)]), pa.int64()) for k, name in enumerate(("a", "b", "links"))})

    return tiles.select("tile", "part", "class", "copies", "side", "set").groupBy("tile").applyInArrow(compare, "a long, b long, links long")


def tiles_of(members: DataFrame, pct: int) -> DataFrame:
    """(class, n, grp) -> (class, tile, part, side): where each class meets others.

    Groups of one block are parts of tiles, a tile holding about a block of them. Larger ones are split by bands of sizes and,
    within these, by a hash, into blocks; each pair of blocks of one band or of neighbouring bands is a tile, so each pair of
    classes that may be linked meets once. All this is worked out without the sets.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / pct)) - 1e-9)
    d = members.select("class", "grp", (F.col("n") * 8).alias("bytes"), band.alias("band"))
    bands = checkpointed(d.groupBy("grp", "band").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes")))
    blocks = lambda size, byte: F.ceil(F.greatest(F.col(size) / TILE, F.col(byte) / TILE_BYTES))
    sizes = bands.groupBy("grp").agg(F.sum("size").alias("size"), F.sum("bytes").alias("bytes")).filter("size > 1").withColumn("whole", blocks("size", "bytes") <= 1)
    total = sizes.filter("whole").agg(F.greatest(F.sum("size") / TILE, F.sum("bytes") / TILE_BYTES).alias("n")).first()["n"] or 0
    large = checkpointed(sizes.filter(~F.col("whole")).select(F.col("grp").alias("_grp")))
    tile = F.pmod(F.xxhash64("grp"), F.lit(max(1, int(total))))
    if large.isEmpty():
        return d.join(sizes.select(F.col("grp").alias("_grp")), F.col("grp") == F.col("_grp")).select("class", tile.alias("tile"), F.col("grp").alias("part"), F.lit(0).alias("side"))
    # of the groups within one block, each has no more rows than one
    small = spread_join(d, large, {"grp": "_grp"}, ["class"], "left_anti")
    small = small.join(sizes.filter("whole").select(F.col("grp").alias("_grp")), F.col("grp") == F.col("_grp"))
    small = small.select("class", tile.alias("tile"), F.col("grp").alias("part"), F.lit(0).alias("side"))
    split = checkpointed(bands.join(large, F.col("grp") == F.col("_grp")).select(F.col("grp").alias("_grp"), F.col("band").alias("_band"), blocks("size", "bytes").alias("blocks")))
    d = spread_join(d, split, {"grp": "_grp", "band": "_band"}, ["class"]).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "class"), F.col("blocks")))
    one = split.select(F.col("_grp").alias("grp"), F.col("_band").alias("band"), "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    # the blocks that each block meets: itself and later ones of its band, all of the next band
    after = split.select("_grp", F.col("_band").alias("next"), F.col("blocks").alias("more"))
    one = one.join(after, (F.col("grp") == F.col("_grp")) & (F.col("next") == F.col("band") + 1), "left")
    to = lambda band, a, n: F.when(n > a, F.transform(F.sequence(a, n - 1), lambda k: F.struct(band.alias("band"), k.alias("block")))).otherwise(F.array().cast("array<struct<band:bigint,block:bigint>>"))
    others = F.concat(to(F.col("band"), F.col("block"), F.col("blocks")), to(F.col("band") + 1, F.lit(0).cast("long"), F.coalesce("more", F.lit(0).cast("long"))))
    pairs = one.select("grp", "band", "block", F.explode(others).alias("other"))
    same = (F.col("other.band") == F.col("band")) & (F.col("other.block") == F.col("block"))
    pairs = pairs.withColumn("tile", F.xxhash64("grp", "band", "block", "other.band", "other.block")).withColumn("same", same)
    sides = pairs.select("grp", "band", "block", "tile", F.when(F.col("same"), 0).otherwise(1).alias("side"))
    sides = sides.unionAll(pairs.filter("not same").select("grp", F.col("other.band").alias("band"), F.col("other.block").alias("block"), "tile", F.lit(2).alias("side")))
    # a block has a bounded number of classes, so none of these keys is hot
    met = d.join(sides, ["grp", "band", "block"]).select("class", "tile", F.col("tile").alias("part"), "side")
    return small.unionAll(met)


def all_links(sets: DataFrame, groups: DataFrame, copies: DataFrame, pct: int) -> DataFrame:
    """(class, n, set), (node, root) of candidates and (class, copies) -> (a, b, links), in one row or more for each linked class."""
    members = sets.select("class", "n").join(groups, F.col("class") == F.col("node")).select("class", "n", F.col("root").alias("grp"))
    met = tiles_of(checkpointed(members), pct).withColumnRenamed("class", "_class")
    d = sets.select("class", "set").join(copies, "class")
    return checkpointed(links_of(met.join(d, F.col("_class") == F.col("class")), pct))


def ngram_join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, pct: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least id among what links lead to), class_id (the least
    id of the rows with an equal set) and n_links (how many other rows the row is linked with, repeated rows included).

    Two rows are linked if 100 * intersection >= pct * union of their sets of width words in a row (of all words, if
    fewer; A-Z in lower case). Null, empty and blank texts have empty sets and are linked with nothing: their component and
    class are their own id. Rows with equal sets are linked whatever their ids, so repeated rows are linked with each
    other; a null id comes before all others, as a component too. No rows: none come back. Texts of any length are
    hashed whole, in pieces of bounded size; a very long one is a block of its own. Other columns of docs are not looked at.
    """
    null = -(1 << 63)
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(null)).alias("id"), F.col(text).alias("text"))
    with small_batches(spark):
        return _joined(d, null, width, pct)


def _joined(d: DataFrame, null: int, width: int, pct: int) -> DataFrame:
    rows = checkpointed(classes(d, width))
    each = rows.filter("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("u").alias("u"), F.count("*").alias("copies"))
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    shared = shared_counts(d, width, pct, max(1, int(total * PART) // BUCKET + 1))
    alone = F.col("u") - F.coalesce(F.when(F.col("n") < WHOLE, F.col("whole")).otherwise(F.col("part")), F.lit(0))
    left = each.join(shared, "class", "left").filter(alone <= F.col("n") - F.ceil(F.col("n") * pct / 100)).select("class", F.col("id").alias("_id"), "n")
    left = checkpointed(left)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            own = pa.array([class_of(s) for s in sets], pa.int64())
            made = pa.record_batch([own, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "set"])
            yield made.filter(pc.equal(own, batch.column("class")))

    # a class's least id may be that of other rows too: only those with its set are kept
    sets = d.join(left.select("class", "_id"), F.col("id") == F.col("_id")).select("class", "text").mapInArrow(again, "class long, n long, set binary").dropDuplicates(["class"])
    sets = checkpointed(sets)
    size = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    pairs = checkpointed(shared_rows(sets, max(1, size // BUCKET + 1)))
    often = pairs.groupBy("t").agg(F.count("*").alias("df")).withColumnRenamed("t", "_t")
    known = uneven_join(pairs, checkpointed(often), {"t": "_t"}, "df")
    own = known.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("own"))
    own = own.join(sets.select(F.col("class").alias("_class"), "n"), F.col("class") == F.col("_class"))
    most = F.col("n") - F.ceil(F.col("n") * pct / 100) + 1 - (F.col("n") - F.size("own"))
    heads = own.filter(most > 0).select("class", F.explode(F.slice("own", F.lit(1), most.cast("int"))).alias("head"))
    heads = checkpointed(heads.select("class", F.col("head")["t"].alias("t")))
    hubs = heads.groupBy("t").agg(F.min("class").alias("b"), F.count("*").alias("k")).filter("k > 1").withColumnRenamed("t", "_t")
    groups = components(uneven_join(heads, checkpointed(hubs), {"t": "_t"}, "k").select(F.col("class").alias("a"), "b"))
    found = all_links(sets, groups, each.select("class", "copies"), pct)
    together = components(found.select("a", "b"))
    sums = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("links"))
    roots = each.join(together, F.col("class") == F.col("node"), "left").select("class", "id", "copies", F.coalesce("root", "class").alias("root"))
    roots = roots.join(sums, F.col("class") == F.col("_a"), "left").withColumn("links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    least = roots.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "_root")
    by_class = roots.join(least, F.col("root") == F.col("_root")).select(F.col("class").alias("_class"), "component_id", F.col("id").alias("class_id"), "links")
    out = rows.join(by_class, (F.col("class") == F.col("_class")) & (F.col("n") > 0), "left")
    real = lambda c: F.nullif(c, F.lit(null))
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component_id", "id")).alias("component_id"), real(F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is their component's, columns as they were.

    An id that comes more than once keeps one row for each of its texts that is not linked to a lesser id.
    """
    key, times, rid = fresh(docs, "key", "times", "rid")
    kept = ngram_join(docs, doc_id=doc_id, text=text, **options).groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(times), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")).filter("kept").select(key, times)
    on = F.col(doc_id).eqNullSafe(F.col(key))
    once = docs.join(kept.filter(F.col(times) == 1), on, "left_semi")
    more = docs.join(kept.filter(F.col(times) > 1), on, "left_semi").withColumn(rid, F.xxhash64(F.lit(7), F.col(text)))
    return once.unionAll(more.dropDuplicates([doc_id, rid]).drop(rid))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
in_both AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, p.n = q.n AND k = p.n AS equal FROM in_both JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
own AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE equal) AS other FROM links GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id::BIGINT AS component_id,
  least(d.doc_id, coalesce(own.other, d.doc_id))::BIGINT AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.a = d.doc_id LEFT JOIN own ON own.a = d.doc_id
"""
