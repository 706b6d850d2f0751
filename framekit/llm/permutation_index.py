"""Approximate nearest neighbours by a permutation index.

Every vector is represented by all pivots in the order of their nearness to it
and posted in the inverted file of its nearest pivot. A vector's order is kept
as one bit for each pivot and step of places ("is the pivot before this place?"),
so that Spearman's footrule, counted in those steps, is the number of bits in
which two orders differ. A query takes the footrule to a sample of the index to
find the distance that as many vectors lie within as it may rank again, skips
the files that can't hold any of them (footrule is a metric and every file has a
centre and a radius), and ranks the others' vectors within that distance by the
exact inner product.

Files are packed into shards of a bounded number of rows; a large file is
several parts. Vectors go to one shard each; queries go to the shards that hold
a file that they visit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship

#: Pivots, steps that their places are counted in, and vectors that pivots are chosen from and thresholds found by (a bounded sample).
PIVOTS, STEPS, PIVOT_SAMPLE = 256, 4, 2048
#: Vectors that a query ranks again: this many times the root of the index's rows, and at least so many.
RERANK_ROOT, RERANK_LEAST = 8, 64
#: Rows in a shard, at least and at most, of its queries at most, and shards at least.
SHARD_LEAST, SHARD_MOST, QUERY_BLOCK, SHARDS_LEAST = 256, 32768, 32768, 16
NEIGHBOURS, QUERY_STEP = 20, 20


def usable(vector: Column) -> Column:
    """Not NULL, not empty, all components finite, and not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Pivots far from each other: each next one is the vector least like those before."""
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        i = int(np.argmin(nearest))
        if nearest[i] > 1 - 1e-9:
            break
        chosen.append(i)
        nearest = np.maximum(nearest, units @ units[i])
    return units[chosen]


def orders(vectors: np.ndarray, pivots: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """All pivots in order of their nearness to each vector.

    Vectors gain a component that brings all to one length, 0 for queries, so
    that nearness in angle is nearness in inner product whatever the lengths.
    """
    extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0))
    near = vectors @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]
    return np.argsort(-near, axis=1, kind="stable")


def coded(order: np.ndarray, pivots: int, steps: int | None = None) -> np.ndarray:
    """Words of bits for each order: whether each pivot stands before the end of each step of places.

    Without ``steps`` every place is a step and the footrule exact. Pivots that
    an order leaves out count as being in the place after its last.
    """
    n, places = order.shape
    place = np.full((n, pivots), places, np.int32)
    np.put_along_axis(place, order.astype(np.int64), np.arange(places, dtype=np.int32)[None, :].repeat(n, 0), axis=1)
    ends = range(1, places + 1) if steps is None else sorted({places * k // steps for k in range(1, steps + 1)} - {0})
    bits = np.concatenate([place < e for e in ends if e < pivots] or [np.zeros((n, 1), bool)], axis=1)
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


class InvertedFiles:
    """Orders of a shard's vectors, file by file."""

    def __init__(self, order: np.ndarray | None, pivots: int, steps: int | None = None, codes: np.ndarray | None = None):
        self.pivots, self.steps = pivots, steps
        codes = coded(order, pivots, steps) if codes is None else codes
        self.rows_total, self.places = len(codes), None if order is None else order.shape[1]
        # Word by word, so that each step runs over neighbouring memory.
        self.words = np.ascontiguousarray(codes.T)

    def differing(self, code: np.ndarray, a: int = 0, b: int | None = None, mask: np.ndarray | None = None) -> np.ndarray:
        """Number of bits that differ from ``code`` in the rows from a to b."""
        total = np.zeros(len(self.words[0, a:b]), np.uint16)
        for k, word in enumerate(code):
            bits = self.words[k, a:b] ^ word
            total += np.bitwise_count(bits if mask is None else bits & mask[k])
        return total

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's order to each vector's, over the query's pivots."""
        ends = self.places if self.steps is None else self.steps
        own = np.zeros((1, self.pivots), bool)
        own[0, order] = True
        packed = np.packbits(np.concatenate([own] * sum(e < self.pivots for e in range(1, ends + 1)), axis=1), axis=1)
        mask = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)[0]
        return self.differing(coded(order[None, :], self.pivots, self.steps)[0], mask=mask).astype(np.float64)


@dataclass
class Index:
    """rows (id, vector, file, code, shard), pivots, greatest length; each file's centre, radius and shards; the sample's codes."""

    rows: DataFrame
    points: np.ndarray
    longest: float
    size: int
    centres: np.ndarray
    radius: np.ndarray
    shards: list[list[int]]
    sample: np.ndarray


def _tour(centres: np.ndarray) -> list[int]:
    """All files, each followed by the nearest one that is left, so that neighbours share shards."""
    left, out = list(range(1, len(centres))), [0] if len(centres) else []
    while left:
        k = int(np.argmin(np.bitwise_count(centres[left] ^ centres[out[-1]]).sum(axis=1)))
        out.append(left.pop(k))
    return out


def _packed(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Shards of each file: files in the order given side by side up to ``most`` rows, larger ones in parts of their own."""
    out: list[list[int]] = [[] for _ in range(max(sizes, default=-1) + 1)]
    shard, room = -1, 0
    for f in sizes:
        parts = -(-sizes[f] // most)
        if parts > 1:
            out[f] = list(range(shard + 1, shard + 1 + parts))
            shard, room = shard + parts, 0
            continue
        if sizes[f] > room:
            shard, room = shard + 1, most
        out[f], room = [shard], room - sizes[f]
    return out


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> Index:
    """The index of all usable vectors.

    Rows with a NULL id, an unusable vector or another number of components than
    most rows have (of equally common numbers the greater) take no part. Pivots
    come from a bounded sample, the first ids in hash order; every row is
    indexed. One row a file, and one number of components, reach the driver.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("most")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim, n, longest = (sizes[0]["d"], sizes[0]["n"], float(np.sqrt(sizes[0]["most"]))) if sizes else (0, 0, 0.0)
    rows = rows.where(F.size("vector") == dim)
    first = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).collect()
    pool = np.array([r["vector"] for r in first], float).reshape(len(first), dim)
    extra = np.sqrt(np.maximum(longest * longest - (pool * pool).sum(axis=1), 0))
    points = choose_pivots(np.concatenate((pool, extra[:, None]), axis=1), pivots) if len(pool) else np.zeros((0, dim + 1))
    count = len(points)
    # A pivot's own order is its file's centre.
    centres = coded(np.argsort(-(points @ points.T), axis=1, kind="stable"), count, STEPS) if count else np.zeros((0, 1), np.uint64)
    schema = T.StructType([*rows.schema.fields, T.StructField("file", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("away", T.IntegerType())])

    def represent(batches):
        for b in batches:
            if b.num_rows:
                order = orders(_matrix(b.column(1)), points, longest)
                codes, file = coded(order, count, STEPS), order[:, 0]
                away = np.bitwise_count(codes ^ centres[file]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(file, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(away, pa.int32())], names=["id", "vector", "file", "code", "away"])

    written = materialize(rows.mapInArrow(represent, schema), "index")
    files = {r["file"]: (r["n"], r["far"]) for r in written.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far")).collect()}
    most = min(SHARD_MOST, max(SHARD_LEAST, n // SHARDS_LEAST))
    shards = _packed({f: files[f][0] for f in _tour(centres) if f in files}, most)
    shards += [[] for _ in range(count - len(shards))]
    radius = np.array([files.get(f, (0, -1))[1] for f in range(count)], np.int64)
    pooled = coded(orders(pool, points, longest), count, STEPS) if count else np.zeros((0, 1), np.uint64)
    return Index(written, points, longest, n, centres, radius, shards, pooled)


def reranked(rows: int) -> int:
    """Vectors that a query ranks by the exact measure, of so many in the index."""
    return max(RERANK_LEAST, int(RERANK_ROOT * rows**0.5))


def search(index: Index, queries: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors found for each query row (id, vector).

    Rows that share the query's id count as its own. Scores are inner products
    in double precision; ties go to the smaller id.
    """
    points, longest, count = index.points, index.longest, len(index.points)
    share = min(1.0, max(reranked(index.size), neighbours + 1) / max(1, index.size))
    within = int(np.ceil(share * len(index.sample)))
    known, centres, radius, shards = index.sample, index.centres, index.radius, index.shards
    every = len({s for own in shards for s in own})

    def aim(batches):
        """Each query's code, its threshold, and the shards that hold a file it visits."""
        sampled = InvertedFiles(None, count, STEPS, known)
        for b in batches:
            if not b.num_rows:
                continue
            codes = coded(orders(_matrix(b.column(1)), points, longest, query=True), count, STEPS)
            limit, visits = [], []
            for c in codes:
                limit.append(int(np.partition(sampled.differing(c), within - 1)[within - 1]) if share < 1 else 1 << 20)
                near = np.flatnonzero((radius >= 0) & (np.bitwise_count(centres ^ c).sum(axis=1) - radius <= limit[-1]))
                visits.append(sorted({s for f in near for s in shards[f]}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(limit, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["query_id", "asked", "code", "limit", "visits"])

    aimed = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("asked", queries.schema["vector"].dataType), T.StructField("code", T.BinaryType()), T.StructField("limit", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
    asked = queries.select("id", "vector").mapInArrow(aim, aimed)
    # More queries of a shard than a task should hold are blocks, each with the shard's rows; most are one block.
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = asked.select("query_id", "asked", "code", "limit", F.explode("visits").alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    # One row a file: bounded by the number of pivots.
    place = F.array(*[F.array(*map(F.lit, own or [0])) for own in shards]) if count else F.array(F.array(F.lit(0)))
    own = F.element_at(place, F.col("file") + 1)
    spread = index.rows.withColumn("shard", F.get(own, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.size(own).cast("bigint")).cast("int")))
    vectors = spread.select("id", "vector", "file", F.col("code").alias("order"), "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), pa.float64()]
        if not held.num_rows or not asking.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        ids, file = held["id"].to_numpy(), held["file"].to_numpy()
        by_file = np.lexsort((ids, file))
        ids, file, matrix = ids[by_file], file[by_file], _matrix(held["vector"])[by_file]
        files = InvertedFiles(None, count, STEPS, _codes(held["order"])[by_file])
        begin = np.concatenate(([0], np.flatnonzero(np.diff(file)) + 1, [len(file)]))
        here = file[begin[:-1]]
        out = ([], [], [])
        for own, vector, code, limit in zip(asking["query_id"].to_pylist(), _matrix(asking["asked"]), _codes(asking["code"]), asking["limit"].to_pylist()):
            visit = np.bitwise_count(centres[here] ^ code).sum(axis=1) - radius[here] <= limit
            # Visited files that stand side by side are read in one go.
            turn = np.flatnonzero(np.diff(np.concatenate(([0], visit.astype(np.int8), [0]))))
            found = [begin[i] + np.flatnonzero(files.differing(code, begin[i], begin[j]) <= limit) for i, j in zip(turn[::2], turn[1::2])]
            found = np.concatenate(found) if found else np.zeros(0, np.int64)
            found = found[ids[found] != own]
            exact = (matrix[found] * vector).sum(axis=1)
            best = np.lexsort((ids[found], -exact))[:neighbours]
            out[0].append(np.full(len(best), own))
            out[1].append(ids[found[best]])
            out[2].append(exact[best])
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(out, types)], names=names)

    pairs = vectors.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, query_step: int = QUERY_STEP, neighbours: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest vectors of every row whose id is divisible by ``query_step``, against all rows.

    Queries that repeat an id are one query, the least of their vectors.
    Repeated rows are all candidates. An empty table, or one without usable
    vectors, gives an empty result. Only the two columns named are read, so
    others may have any name; long vectors are taken whole.
    """
    index = build_index(df, id_col, vector_col)
    asked = index.rows.where(F.col("id") % query_step == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    return search(index, materialize(asked, "queries"), neighbours)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 nearest found for each query of embeddings."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
