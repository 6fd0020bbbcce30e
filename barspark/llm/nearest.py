"""Approximate nearest neighbours with a hash-prefix forest.

Each vector has one long hash string a tree: the signs of its products with random directions, drawn from a
seed.  Vectors are dealt into shards by the first bits of one more hash string, so that near ones share a shard; a
bucket of more than ``SHARD_ROWS`` vectors, such as one vector that very many rows repeat, makes several shards.
A shard keeps, for each tree, its hash strings in a sorted array.  A query descends in every tree to the longest
prefix that anything there shares with its own string; then all trees ascend together, one bit at a time.
What they hold on the way is ranked by the exact measure.  Two vectors at angle a agree in a bit with chance
1 - a / pi, so the k-th best score so far tells how likely a vector as near as that has been met in one tree at
least; the ascent ends when this is ``target``.  Where the nearest are much nearer than the rest it ends after a
few entries; on vectors without structure it has to go on further, see the README for figures.

A query first asks the shards of its own bucket.  Its k-th best score there tells, bit by bit, how likely
a nearer vector lies in another bucket; buckets are asked in the order of that chance, until ``ROUTED`` is reached.

For the inner product, a vector is hashed with one more component that evens out the lengths: the largest
norm is the same for all (Neyshabur and Srebro, 2015); the query has zero there.

Rules: vectors that are null, zero, of another length than most, or hold a null or non-finite component take
no part, neither as query nor as candidate; ties go to the smaller id; rows with one id are candidates each,
and none of them for a query of that id; a query of two rows with one id and different vectors is two queries,
each with its own ranks; fewer than k candidates in the shards asked are all returned, and all shards are asked
where they are fewer; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm._spark import cut

#: Vectors of a shard, and the components they have together at most.
SHARD_ROWS = 32_000
SHARD_VALUES = 4_000_000
QUERY_BLOCK = 10_000
TREES = 128
BITS = 24
#: Chance with which a vector as near as the k-th best one is met.
TARGET = 0.86
#: Chance with which the bucket of such a vector is asked.
ROUTED = 0.98
#: Chance under which a bucket is not looked at further.
LEAST_CHANCE = 1e-4
SEED = 20260711

FOUND = "query long, query_id long, vec_id long, score double, scored long"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v) of the vectors that take part: finite, not zero, and as long as the most common length."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def _evened(vectors: np.ndarray, largest: float) -> np.ndarray:
    """The vectors with the component that evens out their lengths."""
    rest = np.sqrt(np.maximum(0, largest**2 - np.einsum("ij,ij->i", vectors, vectors)))
    return np.column_stack([vectors, rest])


def _as_query(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack([vectors, np.zeros(len(vectors))])


class Forest:
    """The sorted hash arrays of one shard."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, largest: float, trees: int = TREES, bits: int = BITS):
        self.vectors, self.ids, self.largest, self.trees, self.bits = vectors, ids, largest, trees, bits
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        codes = self.codes(_evened(vectors, largest))
        order = np.argsort(codes, axis=0, kind="stable")
        # the arrays of all trees in one, each string led by its tree's number
        self.base = np.arange(trees, dtype=np.int64) << bits
        self.sorted = (np.take_along_axis(codes, order, axis=0).T + self.base[:, None]).ravel()
        self.order = order.T.astype(np.int32).ravel()

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One ``bits`` long hash string a tree, as an integer; vectors have the component that evens out lengths."""
        out = np.empty((len(vectors), self.trees), np.int32)
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.float32)  # exact up to 24 bits
        for a in range(0, len(vectors), 2048):
            signs = (vectors[a : a + 2048].astype(np.float32) @ self.directions > 0).reshape(-1, self.trees, self.bits)
            out[a : a + 2048] = signs.astype(np.float32) @ weights
        return out

    def descend(self, codes: np.ndarray) -> np.ndarray:
        """By query and tree, the length of the longest prefix that an entry of the tree shares."""
        longest = np.zeros(codes.shape, np.int64)
        n = len(self.ids)
        for t in range(self.trees):
            own, keys = self.sorted[t * n : (t + 1) * n], codes[:, t] + self.base[t]
            at = np.searchsorted(own, keys)
            for side in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                differ = np.frexp((own[side] ^ keys).astype(np.float64))[1]  # bits from the first that differs on
                longest[:, t] = np.maximum(longest[:, t], self.bits - differ)
        return longest

    def nearest(self, query: np.ndarray, query_id: int, codes: np.ndarray, longest: np.ndarray, k: int, floor: float, target: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact products of the best k among what the ascent holds, and how many entries it scored.

        floor is a score that the query is known to reach k times elsewhere, or -inf.
        """
        n, size = len(self.ids), float(np.sqrt(query @ query)) * self.largest
        held, parts, best = np.zeros(n, bool), [], np.zeros(0)
        for depth in range(int(longest.max()), -1, -1):
            shift = self.bits - depth
            trees = np.flatnonzero(longest >= depth)
            first = self.base[trees] + ((codes[trees] >> shift) << shift)
            lo, hi = np.searchsorted(self.sorted, first), np.searchsorted(self.sorted, first + (1 << shift))
            sizes = hi - lo
            flat = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            before = held.copy()
            held[self.order[flat]] = True
            fresh = np.flatnonzero(held & ~before)
            fresh = fresh[self.ids[fresh] != query_id]
            if len(fresh):
                near = self.vectors[fresh] @ query
                parts.append((fresh, near))
                best = np.concatenate([best, near])
                best = np.partition(best, len(best) - k)[-k:] if len(best) > k else best
            reached = max(floor, best.min() if len(best) == k else -np.inf)
            if reached > -np.inf:
                agree = 1 - math.acos(max(-1.0, min(1.0, reached / size))) / math.pi
                if 1 - (1 - agree**depth) ** self.trees >= target:
                    break
        found, scores = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
        if len(found) > 4 * k:
            # rounding differs between products of blocks and of pairs: keep a few more, the exact ones decide
            edge = np.partition(scores, len(found) - 2 * k)[len(found) - 2 * k]
            found = found[scores >= edge - 1e-9 * max(1.0, abs(edge))]
        exact = np.array([float(np.dot(self.vectors[i], query)) for i in found])
        best = np.lexsort((self.ids[found], -exact))[:k]
        return self.ids[found][best], exact[best], int(held.sum())


class Router:
    """The buckets of the first ``bits`` bits of one more hash string."""

    def __init__(self, size: int, bits: int, largest: float):
        rng = np.random.default_rng(SEED + 1)
        directions = rng.standard_normal((size + 1, max(bits, 1)))
        self.directions, self.bits, self.largest = directions[:, :bits] / np.linalg.norm(directions[:, :bits], axis=0), bits, largest

    def buckets(self, evened: np.ndarray) -> np.ndarray:
        return ((evened @ self.directions > 0) @ (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)).astype(np.int64)

    def asked(self, query: np.ndarray, score: float | None, target: float) -> list[int]:
        """The buckets, besides the query's own, that are to be asked for vectors that reach a score; all of them without one."""
        if not self.bits:
            return []
        unit = _as_query(query[None])[0] / np.sqrt(query @ query)
        along = unit @ self.directions
        own = int(self.buckets(unit[None])[0])
        buckets, chances = np.zeros(1, np.int64), np.ones(1)
        # a vector at cosine s has s times the query's part along a direction, and a random rest
        s = None if score is None else max(-1.0, min(1.0, score / (math.sqrt(query @ query) * self.largest)))
        for x in along:
            if s is None:
                flips = 0.5
            else:
                spread = math.sqrt(max(1e-12, (1 - s * s) * (1 - x * x) / max(1, len(unit) - 1)))
                flips = 0.5 * math.erfc(s * abs(x) / spread / math.sqrt(2))
            one = 1 - flips if x > 0 else flips
            buckets = np.concatenate([buckets << 1, (buckets << 1) | 1])
            chances = np.concatenate([chances * (1 - one), chances * one])
            if s is not None:
                keep = chances >= LEAST_CHANCE
                buckets, chances = buckets[keep], chances[keep]
        order = np.argsort(-chances, kind="stable")
        enough = len(order) if s is None else int(np.searchsorted(np.cumsum(chances[order]), target)) + 1
        return [int(b) for b in buckets[order[:enough]] if b != own]


def _search(k: int, largest: float, trees: int, bits: int, target: float):
    def run(key, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in FOUND.split(", ")]
        if shard.empty or queries.empty:
            return pd.DataFrame({x: [] for x in names})
        forest = Forest(np.stack(shard["v_"].to_numpy()), shard["id_"].to_numpy(np.int64), largest, trees, bits)
        vectors, ids, floors = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy(np.int64), queries["floor"].to_numpy(np.float64)
        codes = forest.codes(_as_query(vectors))
        longest, out = forest.descend(codes), []
        for i, query in enumerate(queries["query"].to_numpy(np.int64)):
            near, score, scored = forest.nearest(vectors[i], ids[i], codes[i], longest[i], k, floors[i], target)
            out.append(pd.DataFrame({"query": query, "query_id": ids[i], "vec_id": near, "score": score, "scored": [scored, *[0] * (len(near) - 1)] if len(near) else []}))
        return pd.concat(out)[names]

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", column: str = "embedding", trees: int = TREES, bits: int = BITS, target: float = TARGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, n_scored) of the k nearest found for every row for which ``is_query(id)`` holds; n_scored is how many exact products the query took."""
    rows = cut(usable(vectors, key, column).withColumn("row", F.monotonically_increasing_id()))
    stats = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("largest"), F.max(F.size("v")).alias("size")).first()
    largest, size = float(stats["largest"] or 1.0), int(stats["size"] or 1)
    shard_rows = max(1, min(shard_rows, SHARD_VALUES // size))
    router = Router(size, max(0, math.ceil(math.log2(max(1, stats["n"]) / shard_rows))), largest)

    def dealt(batches):
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), np.float64).reshape(-1, size)
            both = [router.buckets(x) if len(v) else np.zeros(0, np.int64) for x in (_evened(v, largest), _as_query(v))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "row")), *map(pa.array, both)], names=["id", "v", "row", "bucket", "home"])

    rows = cut(rows.mapInArrow(dealt, "id long, v array<double>, row long, bucket long, home long"))
    shards = cut(rows.groupBy("bucket").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    index = rows.join(shards.toDF("bucket", "shards"), "bucket").select("id", "v", "bucket", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"))
    queries = rows.filter(is_query(F.col("id"))).groupBy("id", "v").agg(F.min("row").alias("query"), F.min("home").alias("home"))
    queries = cut(queries)

    def search(asked: DataFrame) -> DataFrame:
        """asked: query, id, v, floor, bucket.  Queries of one bucket meet each of its shards, in blocks."""
        blocks = asked.groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        blocks = cut(blocks)
        left = index.join(blocks.toDF("bucket", "n_blocks"), "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        left = left.toDF(*(f"{c}_" for c in left.columns))
        right = asked.join(blocks, "bucket").join(shards, "bucket").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        by = ("bucket", "shard", "block")
        run = _search(k, largest, trees, bits, target)
        return left.groupBy(*(f"{c}_" for c in by)).cogroup(right.groupBy(*by)).applyInPandas(lambda key, a, b: run(key, a, b), FOUND)

    found = cut(search(queries.select("query", "id", "v", F.lit(float("-inf")).alias("floor"), F.col("home").alias("bucket"))))
    if router.bits:
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        floors = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query", F.col("score").alias("floor"))

        def routed(batches):
            for batch in batches:
                asked = [router.asked(np.array(v), f, ROUTED) for v, f in zip(batch.column("v").to_pylist(), batch.column("floor").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("query", "id", "v", "floor")] + [pa.array(asked, pa.list_(pa.int64()))], names=["query", "id", "v", "floor", "buckets"])

        asked = queries.join(floors, "query", "left").select("query", "id", "v", "floor").mapInArrow(routed, "query long, id long, v array<double>, floor double, buckets array<long>")
        asked = cut(asked.select("query", "id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.explode("buckets").alias("bucket")))
        found = cut(found.unionByName(search(asked)))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("n_scored", F.sum("scored").over(Window.partitionBy("query")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
