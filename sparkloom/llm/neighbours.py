"""Approximate nearest neighbours by adaptive dimension scan over probed lists.

Vectors are multiplied by a random rotation, so that every block of columns
holds a fair share of a distance, and dealt to the lists of k-means centres.  A
query probes its nearest lists until they hold ``probe_share`` of all vectors
(and enough for an answer).  Within a list the columns are scanned block by
block: after ``d`` of ``D`` columns, a candidate whose partial squared distance
exceeds ``radius**2 * d / D * (1 + eps / sqrt(d))**2`` is abandoned, as the
hypothesis that its full distance is within the query's current radius can be
rejected.  Every bound is widened by what rotation can round, so that rounding
alone abandons no candidate.  Candidates that survive all blocks are measured
exactly on the original vectors.

Rotation and centres are fitted on a bounded sample of ``sample`` vectors drawn
by a hash; every vector is indexed.  A list of many vectors is split in parts
of ``part_rows``, and queries go to every part of a list they probe, so no list
is one task's work; each part returns at most ``k`` rows a query.

Defined results
---------------
* null or zero vectors, vectors with null or non-finite components, and vectors
  whose length is not the most frequent one (ties: the longest) take no part;
* null ids take no part; equal distances go to the smaller id; rows of one id are
  rows of their own: each is a candidate of every other row, and each that is a
  query has its own answer;
* fewer than ``k`` candidates: all are returned; an empty table gives no rows;
* extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.storage import stage

#: Columns in the first block; every next block is twice as wide.
FIRST_BLOCK = 8
#: Share of the squared lengths by which rotated distances may be off; no candidate is abandoned for less.
ROUNDING = 1e-12


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id long, vector array<double>`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["size"] if sizes else 0))


def random_rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres_of(points: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """K-means centres of a sample."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(rounds):
        own = nearest_list(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=lists)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]


def nearest_list(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])


def column_blocks(dim: int) -> list[tuple[int, int]]:
    out, start, width = [], 0, FIRST_BLOCK
    while start < dim:
        out.append((start, min(dim, start + width)))
        start, width = out[-1][1], width * 2
    return out


def scan_list(query: np.ndarray, rotated: np.ndarray, radius: float, eps: float, slack: np.ndarray) -> np.ndarray:
    """Rows of ``rotated`` that no test abandons for a query with this radius; every bound is wider by a row's ``slack``."""
    dim = len(query)
    alive = np.arange(len(rotated))
    partial = np.zeros(len(rotated))
    for a, b in column_blocks(dim):
        partial = partial + ((rotated[alive, a:b] - query[a:b]) ** 2).sum(1)
        if math.isfinite(radius):
            bound = radius**2 * (b / dim) * ((1 + eps / math.sqrt(b)) ** 2 if b < dim else 1 + 1e-9)
            keep = partial <= bound + slack
            alive, partial, slack = alive[keep], partial[keep], slack[keep]
    return alive


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(1))


def _search_part(k: int, eps: float, rotation: np.ndarray):
    def search(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            data = np.stack(rows["vector"].to_numpy())
            rotated, ids = data @ rotation, rows["vec_id"].to_numpy()
            lengths = (rotated**2).sum(1)
            first = min(len(data), max(8 * k, 64))
            places = rows["row"].to_numpy()
            for row, qid, vector in zip(queries["query_row"], queries["query_id"], queries["query"], strict=True):
                q = np.asarray(vector)
                turned = q @ rotation
                slack = ROUNDING * ((q**2).sum() + lengths)
                best_d, best_i = np.empty(0), np.empty(0, np.int64)
                radius, step = math.inf, first
                for start in range(0, len(data), step):
                    near = start + scan_list(turned, rotated[start : start + step], radius, eps, slack[start : start + step])
                    near = near[places[near] != row]
                    d, i = np.concatenate([best_d, exact(q, data[near])]), np.concatenate([best_i, ids[near]])
                    order = np.lexsort((i, d))[:k]
                    best_d, best_i = d[order], i[order]
                    radius = best_d[-1] if len(best_d) == k else math.inf
                out.append(pd.DataFrame({"query_row": row, "query_id": qid, "vec_id": best_i, "score": best_d}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return search


def _assign(centres: np.ndarray):
    def assign(vectors: pd.Series) -> pd.Series:
        return pd.Series(nearest_list(np.stack(vectors.to_numpy()), centres).astype(np.int32)) if len(vectors) else pd.Series(dtype="int32")

    return F.pandas_udf(assign, "int")


def _probe(centres: np.ndarray, counts: np.ndarray, wanted: float):
    def probe(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            order = squared(np.asarray(v)[None, :], centres)[0].argsort(kind="stable")
            upto = counts[order].cumsum()
            out.append(order[: int(np.searchsorted(upto, wanted)) + 1].tolist())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(probe, "array<int>")


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lists: int = 64,
    probe_share: float = 0.65,
    eps: float = 2.1,
    sample: int = 20_000,
    part_rows: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest found for each row for which ``is_query`` (on ``vec_id``) holds: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stage(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    total = rows.count()
    if not total:
        return empty
    draw = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    fitted = np.stack([np.asarray(r["vector"]) for r in rows.where(draw < 1.1 * sample / total).orderBy(draw, "vec_id").limit(sample).collect()])
    centres = centres_of(fitted, min(lists, max(1, len(fitted) // 16)), seed)
    listed = stage(rows.withColumn("list", _assign(centres)("vector")), "ann-lists")
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a list
    counts = np.array([sizes.get(i, 0) for i in range(len(centres))])
    parts = F.element_at(F.array(*[F.lit(max(1, math.ceil(n / part_rows))) for n in counts.tolist()]), F.col("list") + 1)
    wanted = min(float(total), max(probe_share * total, 100.0 * k))
    queries = listed.where(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    probes = queries.select("query_row", "query_id", "query", F.explode(_probe(centres, counts, wanted)("query")).alias("list"))
    probes = probes.select("query_row", "query_id", "query", "list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    spread = listed.select("row", "vec_id", "vector", "list", F.pmod(F.xxhash64("row"), parts.cast("long")).cast("int").alias("part"))
    found = probes.groupBy("list", "part").cogroup(spread.groupBy("list", "part")).applyInPandas(_search_part(k, eps, random_rotation(fitted.shape[1], seed)), "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
