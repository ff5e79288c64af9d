"""Approximate nearest neighbours by collision-counting hashing (operator 2).

Every vector is projected on ``PROJECTIONS`` random lines. Per line the projections are kept
as one sorted array, without buckets. A query looks at the window around its own projection on
each line; windows of all lines grow together, level by level (virtual rehashing: the same
arrays serve all radii). A vector that lies in the windows of at least ``threshold`` lines has
collided often enough and is verified with its exact inner product. A query ends at the level
where enough of the verified vectors are nearer than the level's radius; there is no cap on how
many are verified, and if all else fails the windows end up covering everything.

Inner products are turned into distances by one more coordinate, sqrt(M**2 - |x|**2) with M
the largest norm (0 for unit vectors); queries get 0 there.

Vectors that agree in every component are one entry that carries its smallest ids (no more
than a result can show), so that many copies cost as much as one; equal queries are searched
once. Entries are dealt to shards of bounded size and queries to blocks; every block meets
every shard, each shard's arrays are built once per block, and the best of all shards are
merged with a bounded top list per query.

Vectors that are null, of another length than most, zero, or hold nulls, NaN or infinities take
no part, nor do rows without an id. Rows that repeat an id and a vector count once. Ties go to the smaller id. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm.data import read, stored

PROJECTIONS = 128
# Half width of the windows relative to the radius.
WIDTH = 0.8
# Deviations below the collisions that a vector at the radius has on average.
SLACK = 1.6
# The factor from one radius to the next, and how far beyond its radius a level may end.
GROWTH, REACH = 1.1, 1.08
# Entries of a shard from which its first radius is guessed.
PROBES = 64
SHARD = 25_000
BLOCK = 1_024
# Queries of a block whose windows grow together; bounds the table of counts.
TOGETHER = 256
K = 20


@functools.lru_cache(maxsize=4)
def lines(dimensions: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dimensions, PROJECTIONS))


def threshold() -> int:
    """Collisions asked for.

    A vector at distance R lies in a window of half width WIDTH * R with the same probability
    at every level, so one threshold serves all.
    """
    p = math.erf(WIDTH / math.sqrt(2))
    return math.ceil(PROJECTIONS * p - SLACK * math.sqrt(PROJECTIONS * p * (1 - p)))


class Shard:
    """The sorted arrays of one shard."""

    def __init__(self, vectors: np.ndarray, norm: float):
        self.vectors = vectors
        lift = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
        projected = np.column_stack([vectors, lift]) @ lines(vectors.shape[1] + 1)
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(projected.T), self.order, axis=1)
        self.norm = norm
        # The first radius: where a fifth of a few entries have as many neighbours as are asked for.
        probes = vectors[:: max(1, len(vectors) // PROBES)]
        nearest = np.sort(probes @ vectors.T, axis=1)[:, -min(K + 1, len(vectors))] / np.linalg.norm(probes, axis=1)
        self.first = math.sqrt(max(2 * norm**2 - 2 * norm * float(np.quantile(nearest, 0.8)), 1e-6 * norm**2)) / REACH

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the entries verified, and their inner products."""
        n, m = len(self.vectors), len(queries)
        length = np.linalg.norm(queries, axis=1)
        lifted = np.column_stack([queries * (self.norm / length)[:, None], np.zeros(m)])
        own = lifted @ lines(queries.shape[1] + 1)
        entries, scores = [[] for _ in range(m)], [[] for _ in range(m)]
        count, done = np.zeros((m, n), dtype=np.uint8), np.zeros((m, n), dtype=bool)
        low = high = None
        active, radius, asked = np.arange(m), self.first, threshold()
        while len(active):
            lo = np.array([row.searchsorted(own[active, i] - WIDTH * radius, "left") for i, row in enumerate(self.sorted)]).T
            hi = np.array([row.searchsorted(own[active, i] + WIDTH * radius, "right") for i, row in enumerate(self.sorted)]).T
            going = np.ones(len(active), dtype=bool)
            for at, q in enumerate(active):
                # Windows only grow: what they gained on either side is counted.
                if low is None:
                    gained = [row[a:b] for row, a, b in zip(self.order, lo[at], hi[at])]
                else:
                    gained = [row[a:b] for row, a, b in zip(self.order, lo[at], low[at])] + [row[a:b] for row, a, b in zip(self.order, high[at], hi[at])]
                count[q] += np.bincount(np.concatenate(gained), minlength=n).astype(np.uint8)
                fresh = np.flatnonzero((count[q] >= asked) & ~done[q])
                done[q, fresh] = True
                entries[q].append(fresh)
                scores[q].append(self.vectors[fresh] @ queries[q])
                # |x - q|**2 = 2 * norm**2 - 2 * norm * score / |q| for the lifted vectors
                edge = (2 * self.norm**2 - (REACH * radius) ** 2) * length[q] / (2 * self.norm)
                going[at] = sum(int((s >= edge).sum()) for s in scores[q]) < k and not done[q].all()
            active, low, high = active[going], lo[going], hi[going]
            radius *= GROWTH
        return [(np.concatenate(e), np.concatenate(s)) for e, s in zip(entries, scores)]


def usable(vector: Column, dimensions: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where("id is not null")
    common = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimensions = common.d if common else 0
    kind = rows.schema["v"].dataType.simpleString()
    rows = stored(rows.where(usable(F.col("v"), dimensions)).withColumn("e", F.xxhash64("v")).distinct(), "vectors")
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0] or 1.0
    # Entries: distinct vectors with their smallest ids, cut per task before the shuffle.
    by_vector = Window.partitionBy("e", "v").orderBy("id")
    ids = rows.select("e", "v", "id").distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    entries = stored(ids.groupBy("e", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    queries = stored(rows.where("q").groupBy("e", "v").agg(F.lit(1).alias("one")).drop("one"), "queries")
    n_entries, n_queries = entries.count(), queries.count()
    shards, blocks = max(1, -(-n_entries // SHARD)), max(1, -(-n_queries // BLOCK))
    # A block of queries and a shard of entries meet in one group of bounded size.
    # All four columns are of one type: cogrouped keys are hashed as they are.
    own_block, own_shard = (F.pmod("e", F.lit(n)).cast("int") for n in (blocks, shards))
    left = queries.withColumn("block", own_block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = entries.withColumn("shard", own_shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(queries_of: pa.Table, entries_of: pa.Table) -> pa.Table:
        out = {"e": [], "v": [], "ids": [], "scores": []}
        if queries_of.num_rows and entries_of.num_rows:
            shard = Shard(matrix(entries_of.column("v"), dimensions), norm)
            ids = entries_of.column("ids").combine_chunks()
            starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            asked = matrix(queries_of.column("v"), dimensions)
            told = (pair for i in range(0, len(asked), TOGETHER) for pair in shard.search(asked[i : i + TOGETHER], k + 1))
            for e, raw, (found, score) in zip(queries_of.column("e").to_pylist(), queries_of.column("v").to_pylist(), told):
                if len(found) > 2 * k:
                    # All entries at least as near as the (k + 1)-th.
                    keep = score >= np.partition(score, len(score) - (k + 1))[len(score) - (k + 1)]
                    found, score = found[keep], score[keep]
                listed = np.concatenate([flat[starts[i] : starts[i + 1]] for i in found]) if len(found) else np.zeros(0, dtype=np.int64)
                scores = np.repeat(score, starts[found + 1] - starts[found])
                order = np.lexsort((listed, -scores))[: k + 1]
                out["e"].append(e)
                out["v"].append(raw)
                out["ids"].append(listed[order])
                out["scores"].append(scores[order])
        return pa.table({"e": pa.array(out["e"], pa.int64()), "v": pa.array(out["v"], queries_of.schema.field("v").type), "ids": pa.array(out["ids"], pa.list_(pa.int64())), "scores": pa.array(out["scores"], pa.list_(pa.float64()))})

    met = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    found = met.applyInArrow(search, f"e long, v {kind}, ids array<long>, scores array<double>")
    # Merge the shards: each sends k + 1 at most, one more than asked because of the query itself.
    pairs = found.select("e", "v", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("e", "v", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    best = Window.partitionBy("e", "v").orderBy(F.desc("score"), "vec_id")
    top = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = top.groupBy("e", "v").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    asked = rows.where("q").select(F.col("id").alias("query_id"), "e", "v").distinct()
    told = asked.join(lists, ["e", "v"])
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    rows_out = told.select("query_id", F.posexplode(others).alias("i", "t"))
    return rows_out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dimensions)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op2_neighbours": (op2_neighbours, None)}
