"""Approximate nearest neighbours by largest inner product: inverted lists and an adaptive scan of dimensions.

Vectors get one more component so that all have one length; the largest inner product is then the least distance. A random rotation
spreads what tells vectors apart evenly over the dimensions, and rotated vectors are held in blocks of columns. Within each
list that a query probes, distances are summed block by block, for many queries and vectors of the list at once; after each block a
hypothesis test abandons the pairs whose distance so far makes it improbable (by EPSILON) that they come within the query's limit. Once
few pairs are left, only these go on. What is left at the end is scored exactly on the original vectors. In a query's FIRST nearest
lists the limit is the distance of its k-th nearest in a fixed sample of rows; in its other lists that of the k-th nearest found in the
first ones, and lists that lie wholly beyond it (by their radius) are not looked at: on vectors that cluster these are nearly all.

The lists' centres are fitted on at most SAMPLE rows; every row is indexed. Lists are dealt in blocks of vectors and of queries,
so that one with a third of all rows (copies of one vector) is many tasks' work. Recall is measured in the tests.

Defined results. Vectors that are null, zero, hold null or non-finite components, or are not of the most common length
take no part. Ties go to smaller ids. Fewer candidates than k: all that are found; lists are probed until LEAST
candidates are seen or none is left. Repeated rows are candidates of their own. An id is one query: of several rows with a query's id the
one with the smallest vector asks, and none of them is its candidate. Null ids take no part. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, written

K = 20
SAMPLE = 16_384
#: Rows of the sample that give each query its limit.
LIMITS = 2048
#: Lists that each query looks at: this share of them, and so many at least. On data without structure (random directions)
#: recall follows the share of lists; embeddings that cluster need far less.
PROBES = 24
SHARE = 0.65
FIRST = 4
LEAST = 400
#: Columns of a block; how sure the test has to be.
COLUMNS = 16
EPSILON = 2.1
#: What single precision may add to a squared distance, as a share of both squared lengths: near copies lie below it.
SLACK = 8 * float(np.finfo(np.float32).eps)
VECTORS_A_TASK = 1024
QUERIES_A_TASK = 1024
#: Queries that a task compares at once with a block of vectors; the share of pairs left below which only these go on.
TILE = 256
FEW = 0.1
SEED = 5


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = F.col("v")
    some = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    some = some.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, fine)).where(F.exists(v, lambda x: x != 0))
    usual = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return some.where(F.size("v") == (usual["n"] if usual else 0))


class Index:
    """What every task needs: the rotation, the greatest length, the centres, the sample for limits."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, longest: float, rows: int):
        rng = np.random.default_rng(SEED)
        self.longest = longest
        self.rotation = np.linalg.qr(rng.standard_normal((sample.shape[1] + 1,) * 2))[0].astype(np.float32)
        lists = int(min(max(1, round(np.sqrt(rows) / 2)), len(sample)))
        points = self.rotate(sample)
        centres = points[rng.permutation(len(points))[:lists]]
        for _ in range(8):
            at = self._nearest(points, centres)
            sums = np.zeros_like(centres, dtype=np.float64)
            np.add.at(sums, at, points)
            n = np.bincount(at, minlength=lists)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        self.centres = centres
        self.limit_ids, self.limit_points = ids[:LIMITS], points[:LIMITS]
        self.limit_lists = self._nearest(self.limit_points, centres)

    @staticmethod
    def _nearest(points, centres):
        return np.argmin((centres**2).sum(axis=1) - 2 * (points @ centres.T), axis=1)

    def rotate(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors. Candidates are lengthened to one length, queries get a zero there."""
        more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, self.longest - (vectors**2).sum(axis=1)))
        return np.concatenate([vectors, more[:, None]], axis=1).astype(np.float32) @ self.rotation

    def lists(self, vectors):
        """The list of each vector, and how far it lies from the list's centre."""
        points = self.rotate(vectors)
        at = self._nearest(points, self.centres)
        return at, np.sqrt(((points - self.centres[at]).astype(np.float64) ** 2).sum(axis=1))

    def probes(self, vectors, sizes, probes, least, share):
        """For each query the lists to look at, nearest first."""
        probes = max(probes, int(np.ceil(share * len(sizes))))
        q = self.rotate(vectors, query=True)
        order = np.argsort((self.centres**2).sum(axis=1) - 2 * (q @ self.centres.T), axis=1, kind="stable")
        seen = np.cumsum(sizes[order], axis=1)
        return [o[: max(probes, int(np.searchsorted(s, least)) + 1)] for o, s in zip(order, seen, strict=True)]

    def apart(self, vectors, at, lists):
        """The distances of these queries (rows of vectors) from these lists' centres."""
        q = self.rotate(vectors, query=True).astype(np.float64)
        centres = self.centres.astype(np.float64)
        d = (centres**2).sum(axis=1) - 2 * (q @ centres.T) + (q**2).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(0.0, d[at, lists]))

    def limits(self, ids, vectors, to, k):
        """A distance (squared) within which each query has at least k candidates in its lists; infinite if the sample has fewer."""
        q, points = self.rotate(vectors, query=True).astype(np.float64), self.limit_points.astype(np.float64)
        # in double precision: in single, what is left of the distance of a copy is noise, often below zero
        d = (points**2).sum(axis=1) - 2 * (q @ points.T) + (q**2).sum(axis=1)[:, None]
        d[ids[:, None] == self.limit_ids[None, :]] = np.inf
        looked = np.zeros((len(q), len(self.centres)), dtype=bool)
        for n, lists in enumerate(to):
            looked[n, lists] = True
        d[~looked[:, self.limit_lists]] = np.inf
        return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(q), np.inf)


def _abandon(index: Index, points: np.ndarray, asked: np.ndarray, limits: np.ndarray, slack: np.ndarray):
    """(i, j) of the pairs of queries and points within the queries' limits, by distances summed over blocks of columns."""
    dims, rows, pair = points.shape[1], None, None
    far = np.zeros((len(asked), len(points)), dtype=np.float32)
    limits = np.maximum(limits, 0.0)
    for at in range(0, dims, COLUMNS):
        upto = min(dims, at + COLUMNS)
        x, q = points[:, at:upto], asked[:, at:upto]
        sure = 1 + EPSILON / np.sqrt(upto) if upto < dims else 1.0
        bound = ((limits * (sure**2 * (1 + 1e-4)) + slack) * (upto / dims)).astype(np.float32)
        if rows is None:  # all pairs by one product of matrices
            far += (x**2).sum(axis=1) + (q**2).sum(axis=1)[:, None] - 2 * (q @ x.T)
            keep = far <= bound[:, None]
            if upto == dims or np.count_nonzero(keep) < FEW * keep.size:
                rows, pair = np.nonzero(keep)
                far = far[rows, pair]
        else:
            far = far + ((x[pair] - q[rows]) ** 2).sum(axis=1)
            keep = far <= bound[rows]
            rows, pair, far = rows[keep], pair[keep], far[keep]
    return rows, pair


def scan(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int = K):
    """(query_id, vec_id, score): the k best of these vectors for each of these queries, within its limit."""
    points, asked = index.rotate(vectors), index.rotate(queries, query=True)
    slack = SLACK * (index.longest + (queries**2).sum(axis=1))
    out = []
    for at in range(0, len(queries), TILE):
        tile = slice(at, at + TILE)
        i, j = _abandon(index, points, asked[tile], limits[tile], slack[tile])
        i = i + at
        other = ids[j] != query_ids[i]
        i, j = i[other], j[other]
        for s in range(0, len(i), 1 << 18):  # scores of a bounded number of pairs at once
            a, b = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            score = (vectors[b] * queries[a]).sum(axis=1)
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=np.int64)
            best = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k
            out.append((query_ids[a[best]], ids[b[best]], score[best]))
    none = np.zeros(0, dtype=np.int64)
    return [np.concatenate([none.astype(t), *x]) for t, x in zip((np.int64, np.int64, np.float64), zip(*out, strict=True) if out else ((), (), ()), strict=True)]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(rows: DataFrame, is_query: Column, k: int = K, probes: int = PROBES, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest of all other rows."""
    result = "query_id long, vec_id long, score double"
    some = written(valid(rows), "vectors")
    spark = some.sparkSession
    count, longest = some.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # a fixed number of rows
    index = Index(_matrix(drawn.column("v")), drawn.column("vec_id").to_numpy(), longest, count)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                lists, away = index.lists(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0), b.column(1), pa.array(away)], names=["list", "vec_id", "v", "away"])

    listed = written(some.mapInArrow(assign, "list int, vec_id long, v array<double>, away double"), "lists")
    sizes, radius = np.zeros(len(index.centres), dtype=np.int64), np.zeros(len(index.centres))
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # two numbers a list
        sizes[r["list"]], radius[r["list"]] = r["n"], r["away"]

    def prober(bounded_lists: bool):
        def probe(batches):
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column(1))
                    to = index.probes(v, sizes, probes, least, share)
                    limit = index.limits(b.column(0).to_numpy(), v, to, k)
                    at, lists = np.repeat(np.arange(len(v)), [len(x) for x in to]), np.concatenate(to)
                    nearest = np.maximum(0.0, index.apart(v, at, lists) - radius[lists]) ** 2  # no vector of the list is nearer
                    place = np.concatenate([np.arange(len(x)) for x in to])
                    if bounded_lists:
                        keep = (place < FIRST) | (nearest <= np.maximum(limit[at], 0.0) * (1 + 1e-4) + SLACK * (longest + (v[at] ** 2).sum(axis=1)))
                        at, lists, nearest, place = at[keep], lists[keep], nearest[keep], place[keep]
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0).take(take), b.column(1).take(take), pa.array(limit[at].astype(np.float64)), pa.array(nearest), pa.array(place.astype(np.int32))], names=["list", "query_id", "q", "bound", "nearest", "place"])

        return probe

    probed = "list int, query_id long, q array<double>, bound double, nearest double, place int"
    one = some.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(one.mapInArrow(prober(True), probed), "queries")
    # blocks of each list's vectors and chunks of its queries: a row a list
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / VECTORS_A_TASK).cast("int").alias("blocks")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("chunks")), "list", "left").select("list", "blocks", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    parts = bounded(written(parts, "parts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = listed.select("list", F.monotonically_increasing_id().alias("row"), "vec_id", "v").join(parts, "list")
    left = written(left.select("list", F.pmod(F.xxhash64("vec_id", "row"), "blocks").cast("int").alias("block"), spread("chunks").alias("chunk"), "vec_id", "v"), "dealt")

    def look(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b, c = scan(index, vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v")), queries.column("query_id").to_numpy(), _matrix(queries.column("q")), queries.column("bound").to_numpy(), k)
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    keys = ["list", "block", "chunk"]

    def scanned(queries: DataFrame) -> DataFrame:
        right = queries.join(parts, "list").select("list", spread("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), "chunks").cast("int").alias("chunk"), "query_id", "q", "bound")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, result)

    def best(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    first = written(best(scanned(asked.where(F.col("place") < FIRST))), "first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = asked.where(F.col("place") >= FIRST).join(kth, "query_id", "left")
    # the distance that a score stands for, all vectors having one length
    far = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x) + F.lit(float(longest)) - 2 * F.col("kth")
    rest = rest.withColumn("bound", F.least("bound", far)).drop("kth", "place")
    size = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x) + F.lit(float(longest))
    rest = rest.where(F.col("nearest") <= F.greatest("bound", F.lit(0.0)) * (1 + 1e-4) + SLACK * size)
    found = written(best(first.drop("rank").unionByName(scanned(rest))), "found")
    # a bound that leaves fewer than k was too close: those queries once more, without any
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    short = written(asked.where(F.col("bound") < F.lit(float("inf"))).select("query_id").distinct().join(enough, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        again = one.join(short, F.col("vec_id") == F.col("query_id"), "left_semi").mapInArrow(prober(False), probed)
        again = best(scanned(again.withColumn("bound", F.lit(float("inf"))).drop("place", "nearest")))
        found = found.join(short, "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
