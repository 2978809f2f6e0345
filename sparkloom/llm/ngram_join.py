"""Exact n-gram Jaccard join with count-vector R-trees.

A document is the set of its word shingles; two documents link when the Jaccard
similarity of their sets reaches ``percent`` / 100.  Equal sets form a class and
are handled once.  The join of the classes has three steps.

1. *Blocks.*  Under one order of all shingles, linked sets share a shingle
   among their first ``size - ceil(percent * size / 100) + 1``, the prefix.  Any
   order is exact.  Here shingles of a hash below a bound come first, those of
   the fewest classes leading; they are counted over all classes, and the bound
   is chosen so that they suffice for nearly all prefixes.  Shingles of a single
   class fill most prefixes and link nothing, so that most sets are in no block.
   The home of a shingle is the smallest set that has it, and a block is all
   sets of a band of sizes that share a shingle with this home.  As near
   duplicates share most shingles, a set is in few blocks; linked sets are in
   the same or adjacent bands, and a set also enters the band below its own.
2. *R-tree.*  Shingles are hashed into groups, and a set's group counts are a
   point.  The points of a block are packed into an R-tree by size.  The overlap
   of two sets is at most the sum over coordinates of the smaller count, and of
   two tree nodes at most that of their largest counts; node and point pairs
   below the overlap that a link needs are never looked at again.  A first pass
   over points alone keeps, of each block, the groups of sets connected by pairs
   that are left; each group becomes a block of its own, once.
3. *Verification.*  Only these sets' shingles are fetched.  With points of more
   groups the pairs that survive, best bound first, are compared exactly on their
   shingles, unless links already found connect the two: the result is the
   classes of linked documents, for which a spanning set of links is enough.

A block of more than ``tile`` members, or ``TILE_SHINGLES`` shingles, is cut into
tiles, and each pair of tiles is a unit of its own, so memory has a bound.  Components come from alternating large-star and small-star
steps over tables in the shared folder.

Defined results
---------------
* null text, empty text or text without words: an empty set, linked with nothing;
* fewer words than a shingle: the whole sequence is the one shingle;
* repeated rows and equal texts fall in one class; null ids are kept and never
  the smallest id of a component unless all its ids are null; repeated ids are
  rows of their own; an empty table gives an empty result;
* extra columns are not read;
* rows are told apart by 128 bits of hashes of id and text, classes by 128 bits of
  a digest of their shingles' 64-bit hashes.  Two different shingles of one pair
  of texts agree with a chance below 10**-10, for texts of 20,000 words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.hashing import shingle_sets
from sparkloom.storage import stage, unstage

#: Points of an R-tree leaf, and children of an inner node.
FANOUT = 16
#: Shingles of a tile, about.
TILE_SHINGLES = 4_000_000
#: Shingles a group of the points of the first pass, and bounds of the number of groups.
PER_GROUP, LEAST_GROUPS, MOST_GROUPS = 8, 64, 4096


def needed_overlap(a, b, percent: int):
    """Least common shingles of linked sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size, percent: int):
    """How many first shingles of a set of ``size`` any linked set must meet."""
    return size - -(-percent * size // 100) + 1


def counted_below(percent: int, counted: float) -> np.uint64:
    """The hash below which shingles are counted: ``counted`` times the share of shingles in a prefix."""
    return np.uint64(min((1 << 64) - 1, int(max(counted * (100 - percent), 1) / 100 * (1 << 64))))


def block_keys(shingles: np.ndarray, percent: int, below: np.uint64) -> np.ndarray:
    """The counted shingles of a sorted set, and the next ones where they are fewer than the prefix."""
    n = len(shingles)
    return shingles[: max(prefix_length(n, percent), int(np.searchsorted(shingles, below)))] if n else shingles


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.uint32)


def first_point(shingles: np.ndarray) -> np.ndarray:
    """The point of the first pass; larger sets have more groups, always a power of two."""
    groups = LEAST_GROUPS
    while groups * PER_GROUP < len(shingles) and groups < MOST_GROUPS:
        groups *= 2
    return count_vector(shingles, groups)


def packed(point: np.ndarray) -> bytes:
    """A point in the narrowest integers that hold it, led by their size in bytes."""
    size = 1 if point.max() < 1 << 8 else 2 if point.max() < 1 << 16 else 4
    return bytes([size]) + point.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint32)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points over the fewest groups that any has: groups that agree modulo that number are added."""
    groups = min(map(len, points))
    return np.stack([p.reshape(-1, groups).sum(0) for p in points])


class CountVectorTree:
    """R-tree over group counts; leaves hold sets of similar size."""

    def __init__(self, points: np.ndarray, percent: int, sides: np.ndarray | None = None) -> None:
        """``points`` holds a row a set; with ``sides``, pairs are only sought across them."""
        self.points, self.percent, self.sides = points.astype(np.int32), percent, sides
        self.sizes = self.points.sum(1, dtype=np.int64)
        self.order = np.argsort(self.sizes, kind="stable")
        # Levels from leaves up: first child, end child, largest counts, least size, largest size.
        starts = np.arange(0, len(points), FANOUT)
        ends = np.minimum(starts + FANOUT, len(points))
        ordered, sizes = self.points[self.order], self.sizes[self.order]
        self.levels = [(starts, ends, np.maximum.reduceat(ordered, starts), sizes[starts], sizes[ends - 1])]
        while len(self.levels[-1][0]) > 1:
            _, _, most, low, high = self.levels[-1]
            starts = np.arange(0, len(most), FANOUT)
            ends = np.minimum(starts + FANOUT, len(most))
            self.levels.append((starts, ends, np.maximum.reduceat(most, starts), low[starts], high[ends - 1]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs that the bounds leave: the bound relative to the need, and both sets."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            starts, ends, most, low, high = self.levels[level]
            if 100 * high[a] < self.percent * low[b] or 100 * high[b] < self.percent * low[a]:
                continue
            if np.minimum(most[a], most[b]).sum() < needed_overlap(int(low[a]), int(low[b]), self.percent):
                continue
            if level:
                stack += [(level - 1, i, j) for i in range(starts[a], ends[a]) for j in range(starts[b], ends[b]) if a != b or j >= i]
            else:
                yield self._leaf_pairs(self.order[starts[a] : ends[a]], self.order[starts[b] : ends[b]], a == b)

    def _leaf_pairs(self, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound = np.minimum(self.points[left][:, None, :], self.points[right][None, :, :]).sum(2)
        need = needed_overlap(self.sizes[left][:, None], self.sizes[right][None, :], self.percent)
        keep = bound >= need
        if same:
            keep &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        if self.sides is not None:
            keep &= self.sides[left][:, None] != self.sides[right][None, :]
        i, j = np.nonzero(keep)
        return bound[i, j] / need[i, j], left[i], right[j]


def candidate_groups(points: np.ndarray, percent: int, sides: np.ndarray | None = None) -> list[list[int]]:
    """Sets connected by pairs that the bounds leave, in groups of two or more."""
    parent = list(range(len(points)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, left, right in CountVectorTree(points, percent, sides).pairs():
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(len(points)):
        groups.setdefault(root(i), []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def spanning_links(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links that connect all that is linked; with ``sides``, by links across sides."""
    largest = max(len(s) for s in sets)
    groups = int(min(1024, max(64, 1 << (4 * largest).bit_length())))
    tree = CountVectorTree(np.stack([count_vector(s, groups) for s in sets]), percent, sides)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []

    def verify(batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        bound, left, right = (np.concatenate(x) for x in zip(*batch, strict=True))
        for k in np.argsort(-bound, kind="stable").tolist():
            i, j = int(left[k]), int(right[k])
            a, b = root(i), root(j)
            if a != b:
                common = len(sets[i]) + len(sets[j]) - len(np.unique(np.concatenate([sets[i], sets[j]])))
                if common >= needed_overlap(len(sets[i]), len(sets[j]), percent):
                    parent[max(a, b)] = min(a, b)
                    links.append((i, j))

    batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0
    for pair in tree.pairs():
        batch.append(pair)
        waiting += len(pair[0])
        if waiting >= 500_000:  # bounds memory; what is verified, and how, stays the same
            verify(batch)
            batch, waiting = [], 0
    if waiting:
        verify(batch)
    return links


def _sets_udf(n: int, percent: int, below: np.uint64):
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("size", pa.int64()), ("sig", pa.binary()), ("point", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                sizes, sigs, points, keys = [], [], [], []
                for s in shingle_sets(batch["text"].to_pylist(), n):
                    sizes.append(len(s))
                    sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    points.append(packed(first_point(s)))
                    keys.append(block_keys(s, percent, below).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(points, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def prefix_shingles(classes: DataFrame, percent: int, share: float = 0.00001) -> DataFrame:
    """``cid, home`` for each shingle of a class's prefix that another class has too.

    Shingles of at least ``share`` of all rows are at most 1 / ``share`` in
    number and are broadcast, so that none of them meets in one task; the others
    are joined by a shuffle.
    """
    tokens = classes.select("cid", "size", F.size("keys").alias("n_keys"), F.explode("keys").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("home")).where("n > 1")
    shared = stage(shared, "join-shared")
    total = classes.agg(F.sum(F.size("keys"))).collect()[0][0] or 0
    bound = max(2, math.ceil(share * total))
    hot = F.broadcast(shared.where(F.col("n") >= bound))
    slim = tokens.select("cid", "token")
    held = slim.join(hot, "token").union(slim.join(hot, "token", "left_anti").join(shared.where(F.col("n") < bound), "token"))
    held = held.select("cid", "n", "token", "home").join(classes.select("cid", "size", F.size("keys").alias("n_keys")), "cid")
    # Shingles of this class alone lead the order; what is left of the prefix are shared ones, rarest first.
    alone = F.col("n_keys") - F.count(F.lit(1)).over(Window.partitionBy("cid"))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("n", "token"))
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    return held.withColumn("rank", rank + alone).where(F.col("rank") <= prefix).select("cid", "home").distinct()


def row_key(id_: Column, text: Column) -> Column:
    """Two 64-bit hashes of id and text, in 16 bytes."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(digits(F.xxhash64(id_, text)), digits(F.xxhash64(F.lit("check"), text, id_))))


def _to_shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["cid"], pa.array([s.tobytes() for s in shingle_sets(batch["text"].to_pylist(), n)], pa.binary())], names=["cid", "shingles"])

    return run


BLOCK_KEY = ("home", "band", "left", "right")


def _blocks(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple[int, ...], list[int], list[bytes], np.ndarray | None]]:
    """Blocks of sorted rows one by one: key, sets, their values, and their sides if the block is a pair of tiles."""
    current, members, tiles = None, {}, {}

    def block():
        sides = None if current[2] == current[3] else np.array([tiles[i] == current[2] for i in members])
        return current, list(members), list(members.values()), sides

    for batch in batches:
        columns = [batch[c].to_pylist() for c in (*BLOCK_KEY, "cid", "tile")]
        for *key, cid, tile, v in zip(*columns, batch[value], strict=True):
            if key != current:
                if len(members) > 1:
                    yield block()
                current, members, tiles = key, {}, {}
            members[cid], tiles[cid] = v.as_py(), tile
    if len(members) > 1:
        yield block()


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int]] = []
        schema = pa.schema([("home", pa.int64()), ("band", pa.int32()), ("cid", pa.int64())])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema)
            rows.clear()
            return out

        for (_, band, *_), ids, points, sides in _blocks(batches, "point"):
            for group in candidate_groups(folded([unpacked(p) for p in points]), percent, sides):
                # A group gets the home of its own smallest set, so that groups found in many blocks fall together.
                home = min(ids[i] for i in group)
                rows += [(home, band, ids[i]) for i in group]
            if len(rows) > 50_000:
                yield flush()
        yield flush()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"u": [a for a, _ in found], "v": [b for _, b in found]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
            found.clear()
            return out

        for _, ids, values, sides in _blocks(batches, "shingles"):
            found += [(ids[i], ids[j]) for i, j in spanning_links([np.frombuffer(v, np.uint64) for v in values], percent, sides)]
            if len(found) > 50_000:
                yield flush()
        yield flush()

    return run


def _by_block(rows: DataFrame, blocks: DataFrame, share: float = 0.00001) -> DataFrame:
    """Rows with the columns of their blocks (``home, band, members, ...``); rows of no block are left out.

    Blocks that hold at least ``share`` of all members are at most 1 / ``share`` in
    number and are broadcast, so that none of them meets in one task; the others
    are joined by a shuffle.
    """
    blocks = stage(blocks.where("members > 1"), "join-blocks")
    total = blocks.agg(F.sum("members")).collect()[0][0] or 0
    bound = max(2, math.ceil(share * total))
    hot, few = F.broadcast(blocks.where(F.col("members") >= bound)), blocks.where(F.col("members") < bound)
    rest = rows.join(hot.select("home", "band"), ["home", "band"], "left_anti")
    return rows.join(hot, ["home", "band"]).unionByName(rest.join(few, ["home", "band"]))


def _dealt(members: DataFrame, values: DataFrame, tile: int) -> DataFrame:
    """Members with their values, sorted by block; large blocks are dealt to pairs of tiles."""
    blocks = members.groupBy("home", "band").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("members") / tile), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(2), "cid"), tiles.cast("long")).cast("int")
    dealt = _by_block(members, blocks).withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.select("home", "band", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "cid", "tile")
    return dealt.join(values, "cid").repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``); the root is the smallest node of the component."""
    current = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).collect()[0]

    before = state(current)
    while before["n"]:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        following = stage(small, "components")
        after = state(following)
        unstage(current)
        current, done = following, after == before
        before = after
        if done:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())


def link_documents(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tile: int = 4096, counted: float = 1.25) -> DataFrame:
    """One row a document: ``doc_id, row_key, size, component_id, keeper``.

    ``row_key`` holds two hashes of id and text; ``keeper`` marks the row (or repeated
    rows) of each component that has the smallest id.  ``counted`` sets how many
    shingles are counted: that many times those in a prefix.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    below = counted_below(percent, counted)
    sets = stage(rows.mapInArrow(_sets_udf(shingle, percent, below), "doc_id long, row_key binary, size long, sig binary, point binary, keys array<long>"), "join-sets")
    lead = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")
    classes = sets.where("size > 0").groupBy("sig").agg(F.min(lead).alias("lead"), F.first("size").alias("size"), F.first("point").alias("point"), F.first("keys").alias("keys"))
    # A little wider than the ratio of linked sizes, so that rounding never puts them two bands apart.
    band = F.floor(F.log("size") / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("size").cast("int")
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "sig", "lead", "size", band.alias("band"), "point", "keys"), "join-classes")

    near = prefix_shingles(classes, percent).join(classes.select("cid", "size", "band"), "cid")
    near = stage(near.select("home", "cid", "size", F.col("band").alias("own"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")), "join-near")
    alive = near.groupBy("home", "band").agg(F.count(F.lit(1)).alias("members"), F.min("own").alias("least")).where("least = band")
    members = stage(_by_block(near, alive).select("home", "band", "cid", "size"), "join-members")
    unstage(near)

    points = classes.select("cid", "point")
    paired = stage(_dealt(members, points, tile).mapInArrow(_prune(percent), "home long, band int, cid long").distinct(), "join-paired")

    wanted = classes.join(paired.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("lead.row_key").alias("row_key"))
    texts = rows.select("row_key", "text").join(wanted, "row_key").select("cid", "text").dropDuplicates(["cid"])
    shingles = stage(texts.mapInArrow(_to_shingles(shingle), "cid long, shingles binary"), "join-shingles")
    sized = stage(paired.join(classes.select("cid", "size"), "cid"), "join-sized")
    links = stage(_dealt(sized, shingles, tile).mapInArrow(_verify(percent), "u long, v long"), "join-links")
    unstage(members, paired, sized, shingles)

    roots = stage(components(links), "join-roots")
    unstage(links)
    grouped = classes.join(roots, classes["cid"] == roots["node"], "left").select("sig", "lead", F.coalesce("root", "cid").alias("root"))
    leads = grouped.join(grouped.groupBy("root").agg(F.min("lead").alias("first")), "root").select("sig", "first")
    full = sets.select("doc_id", "row_key", "size", "sig").join(leads, "sig", "left")
    own_id = F.when(F.col("size") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "row_key", "size", own_id.alias("component_id"), (F.coalesce(F.col("first.row_key"), F.col("row_key")) == F.col("row_key")).alias("keeper"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs``, with all its columns, without all but one row of each component."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    linked = stage(link_documents(docs, **options), "join-rows")
    dropped = linked.where("not keeper").select("row_key").distinct()
    repeated = linked.where("keeper and size > 0").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key")
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.struct("*").alias("_row"))
    kept = keyed.join(dropped, keyed["_key"] == dropped["row_key"], "left_anti")
    if repeated.isEmpty():
        return kept.select("_row.*")
    single = kept.join(repeated, kept["_key"] == repeated["row_key"], "left_anti")
    copies = kept.join(repeated, kept["_key"] == repeated["row_key"], "left_semi").dropDuplicates(["_key"])
    return single.union(copies).select("_row.*")
