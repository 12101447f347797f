"""Centroid clustering (Lloyd's rounds) with bounds in heaps.

Every vector has a gap: the distance to its second nearest centroid less that to its nearest one. When centroids move, a vector's gap shrinks by no
more than its own centroid's drift and the largest drift of another. So each cluster keeps a heap of its vectors by ``gap + offset``, where the
cluster's offset is the sum of these shrinkages so far: what stands above the offset is still right, and no vector below the top of a heap needs a look.
Each round pops the vectors whose gap has expired, measures these alone against all centroids, in whole numbers, and pushes them
onto the heap of their nearest centroid.

Vectors are dealt by a hash of what they are into blocks, written once in buckets; the heaps of a block are written by each round in the same buckets, so
that both join without a shuffle, the vectors are never written again, and a lost executor costs no more than its tasks. A round gives the sums of
the vectors that moved, added up in tasks; the driver holds centroids and sums of as many clusters, never rows. Rows that repeat are one vector
with a count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dropped, few_rows, finite, saved, whole

MOST = 1 << 27  # a component's size, so that squared distances of 256 components fit a long
SLACK = 1e-9  # bounds are widened by so much, relatively, as they are no whole numbers

Heap = list[tuple[float, int]]


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exactly: rows x centroids."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = np.square(x - c).sum(1)
    return out


def advance(x: np.ndarray, weight: np.ndarray, heaps: list[Heap] | None, centroids: np.ndarray, offsets: np.ndarray) -> tuple[list[Heap], np.ndarray, np.ndarray, int]:
    """One assignment of a block: the heaps, how sums and counts of clusters change, and how many vectors were measured. ``heaps`` is None at first."""
    k = len(centroids)
    if heaps is None:
        heaps, rows, was = [[] for _ in range(k)], np.arange(len(x)), np.full(len(x), -1)
    else:
        expired: list[tuple[int, int]] = []
        for a, heap in enumerate(heaps):
            limit = float(offsets[a])
            while heap and heap[0][0] <= limit:
                expired.append((heappop(heap)[1], a))
        rows, was = np.array(expired, np.int64).reshape(-1, 2).T
    sums, counts = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
    if not len(rows):
        return heaps, sums, counts, 0
    far = squared(x[rows], centroids)
    near = far.argmin(1)  # ties: the smaller number
    own = np.sqrt(far[np.arange(len(rows)), near].astype(np.float64))
    if k > 1:
        second = np.sqrt(np.partition(far, 1, axis=1)[:, 1].astype(np.float64))
        keys = second * (1 - SLACK) - own * (1 + SLACK) + offsets[near]
    else:
        keys = np.full(len(rows), np.inf)
    for row, a, key in zip(rows.tolist(), near.tolist(), keys.tolist(), strict=True):
        heappush(heaps[a], (key, row))
    moved = np.flatnonzero(near != was)
    w = weight[rows[moved]]
    wx = x[rows[moved]] * w[:, None]
    np.add.at(sums, near[moved], wx)
    np.add.at(counts, near[moved], w)
    left = was[moved] >= 0
    np.subtract.at(sums, was[moved][left], wx[left])
    np.subtract.at(counts, was[moved][left], w[left])
    return heaps, sums, counts, len(rows)


def packed(heaps: list[Heap]) -> tuple[list[int], bytes, bytes]:
    """Sizes of the heaps, and their keys and rows in the heaps' order."""
    keys, rows = np.array([key for h in heaps for key, _ in h], np.float64), np.array([row for h in heaps for _, row in h], np.int32)
    return [len(h) for h in heaps], keys.tobytes(), rows.tobytes()


def unpacked(sizes: list[int], keys: bytes, rows: bytes) -> list[Heap]:
    pairs = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(rows, np.int32).tolist(), strict=True))
    ends = np.cumsum([0, *sizes]).tolist()
    return [pairs[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _blocks(rows: DataFrame, dim: int, tasks: int) -> DataFrame:
    """(block, ids, counts, vectors) of rows (block, id, n, v)."""
    sorted_ = rows.repartition(tasks, "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.int32)
            return pa.RecordBatch.from_arrays([t["block"].slice(0, 1).combine_chunks(), pa.array([t["id"].to_pylist()], pa.list_(pa.int64())), pa.array([t["n"].to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()])], names=["block", "ids", "counts", "v"])

        for batch in batches:
            names = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("block")[0].as_py() != names[i]:
                    yield block()
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield block()

    return sorted_.mapInArrow(run, "block long, ids array<long>, counts array<long>, v binary")


STATE = "block long, sizes array<int>, keys binary, heap_rows binary, moved array<long>, measured long"


def _round(table: DataFrame, centroids: np.ndarray, offsets: np.ndarray, dim: int) -> DataFrame:
    """The heaps of each block after an assignment; ``moved`` has the changes of sums and counts, null where nothing has."""
    started = "sizes" in table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["v"], np.int32).reshape(-1, dim).astype(np.int64)
                heaps = unpacked(r["sizes"], r["keys"], r["heap_rows"]) if started else None
                heaps, sums, counts, measured = advance(x, np.array(r["counts"], np.int64), heaps, centroids, offsets)
                change = [*sums.ravel().tolist(), *counts.tolist()] if counts.any() or sums.any() else None
                sizes, keys, rows = packed(heaps)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([sizes], pa.list_(pa.int32())), pa.array([keys]), pa.array([rows]), pa.array([change], pa.list_(pa.int64())), pa.array([measured])], names=["block", "sizes", "keys", "heap_rows", "moved", "measured"])

    columns = ["block", "counts", "v"] + ["sizes", "keys", "heap_rows"] * started
    return table.select(columns).mapInArrow(run, STATE)


def _added(moved: DataFrame, size: int) -> np.ndarray:
    """The sum of all changes: each task adds up its own, so that at most ``size`` numbers a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += batch.column("moved").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["moved"])

    parts = moved.select("moved").filter("moved is not null").mapInArrow(run, "moved array<long>")
    rows = parts.select(F.posexplode("moved").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.i] = r.x
    return out


def _assigned(table: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """(id, n, cluster, distance) of each vector, as the heaps have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["v"], np.int32).reshape(-1, dim).astype(np.int64)
                cluster = np.empty(len(x), np.int32)
                cluster[np.frombuffer(r["heap_rows"], np.int32)] = np.repeat(np.arange(len(r["sizes"])), r["sizes"])
                far = np.square(x - centroids[cluster]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["counts"], pa.int64()), pa.array(cluster), pa.array(far)], names=["id", "n", "cluster", "distance"])

    return table.select("ids", "counts", "v", "sizes", "heap_rows").mapInArrow(run, "id long, n long, cluster int, distance long")


def clusters(
    df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, order: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048, bucket_rows: int = 1 << 17,
    log: list[dict] | None = None,
) -> DataFrame:
    """``id_col``, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector with ``dim`` components, after so many rounds.

    Components become ``floor(scale * x)``; vectors of another length, null, or with a null or non-finite component take no part. Centroids start as the ``k``
    vectors that come first by ``order`` (a column; nulls last; by default sha256 of ``3:<id>``), ties by id and vector; fewer vectors give fewer
    clusters. A centroid becomes ``floor(sum / count)`` of its vectors by component; an empty one stays. Ties of distance go to the smaller number.
    Repeated rows each count and each have a row of the result; rows with a null id count too, but start no centroid before others do. Other columns aren't carried,
    whatever their names. An empty table gives no rows. Components beyond ``2^27`` after scaling are an error.

    ``log`` receives, per assignment, how many vectors were measured, for tests and reports.
    """
    spark = df.sparkSession
    first = F.sha2(F.concat(F.lit("3:"), F.col(id_col).cast("string")), 256) if order is None else order
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), first.alias("first"), v.alias("v")).filter((F.size("v") == dim) & finite(F.col("v")))
    rows = rows.select("id", "first", whole(F.col("v"), scale, MOST).alias("v"))
    vectors = saved(rows.groupBy("id", "v").agg(F.min("first").alias("first"), F.count("*").alias("n")))
    total = vectors.count()
    starts = vectors.orderBy(F.asc_nulls_last("first"), F.asc_nulls_last("id"), "v").limit(k).select("n", "v").collect()
    centroids = np.array([r.v for r in starts for _ in range(min(r.n, k))][:k], np.int64).reshape(-1, dim)
    k = len(centroids)
    kept = f"{id_col} {dict(df.dtypes)[id_col]}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not k:
        return spark.createDataFrame([], kept)
    blocks = -(-total // block_rows)
    buckets = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows)))
    offsets, sums, counts = np.zeros(k), [[0] * dim for _ in range(k)], [0] * k
    numbered = vectors.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), "id", "n", "v")
    with few_rows(spark, 4096):
        static_name, static = bucketed(_blocks(numbered, dim, buckets), buckets, "block")
    state_name = state = None
    with few_rows(spark, 16):
        for i in range(rounds + 1):
            table = static if state is None else static.join(state.drop("moved", "measured"), "block")
            name, new = bucketed(_round(table, centroids, offsets, dim), buckets, "block")
            if state_name:
                dropped(spark, state_name)
            state_name, state = name, new
            if log is not None:
                log.append({"round": i, "measured": state.agg(F.sum("measured")).first()[0], "of": total})
            if i == rounds:
                break
            change = _added(state, k * (dim + 1)).tolist()
            # Whole numbers of any size: sums of all rows needn't fit 64 bits.
            sums = [[a + b for a, b in zip(s, change[j * dim : (j + 1) * dim], strict=True)] for j, s in enumerate(sums)]
            counts = [a + b for a, b in zip(counts, change[k * dim :], strict=True)]
            moved = np.array([[s // n for s in row] if n else c.tolist() for row, n, c in zip(sums, counts, centroids, strict=True)], np.int64)
            drift = np.array([math.sqrt(sum(int(d) ** 2 for d in row)) for row in moved - centroids]) * (1 + SLACK)
            centroids = moved
            if not drift.any():
                break  # nothing can change any more
            others = np.array([max([x for j, x in enumerate(drift) if j != a], default=0.0) for a in range(k)])
            offsets = (offsets + drift + others) * (1 + SLACK)
        found = saved(_assigned(static.join(state.drop("moved", "measured", "keys"), "block"), centroids, dim))
    for name in (static_name, state_name):
        dropped(spark, name)
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values, kind: F.get(F.array(*map(F.lit, values)), F.col("cluster")).cast(kind)
    # Repeated rows, in two steps, so that no array grows with their number.
    many = 10_000
    often = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / many))))
    often = often.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(many), F.col("n") - F.col("part") * many))))
    return often.select(
        F.col("id").cast(dict(df.dtypes)[id_col]).alias(id_col), "cluster", "distance", pick([per.get(j, 0) for j in range(k)], "long").alias("cluster_inertia"), F.lit(sum(per.values())).cast("long").alias("inertia"), pick(digest, "string").alias("centroid_sha256"),
    )


def sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> str:
    """The same in DuckDB's SQL, every vector against every centroid in each round."""
    out = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        "parts AS (SELECT r, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, r FROM kept QUALIFY j < {k})",
        "c0 AS (SELECT j, i, x AS c FROM first JOIN parts USING (r))",
    ]
    for n in range(rounds + 1):
        out.append(f"d{n} AS (SELECT r, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM parts JOIN c{n} USING (i) GROUP BY ALL)")
        out.append(f"a{n} AS (SELECT r, arg_min(j, struct_pack(d := d, j := j)) AS j, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            out.append(f"m{n} AS (SELECT j, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM a{n} JOIN parts USING (r) GROUP BY ALL)")
            out.append(f"c{n + 1} AS (SELECT j, i, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (j, i))")
    last = rounds
    return (
        "WITH " + ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out) + f", names AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY j)"
        f" SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{last} JOIN kept USING (r) JOIN names USING (j)"
    )
