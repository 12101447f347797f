"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, and rotated so that the signs lose least (iterative quantisation on a bounded sample; several
rotations where a code has more bits than a vector has dimensions). A code is split into ``m`` substrings and each substring is indexed:
a row is stored once for each, in the cell of that substring's first bits.

Pigeonhole: of two codes within a Hamming radius ``r = m * a + b``, one of the first ``b + 1`` substrings differs in at most ``a`` bits, or
one of the others in at most ``a - 1``. A query probes the cells that such substrings can be in, which finds every code within the radius. Each pair
is taken at the first substring that tells it, so that no pair is met twice. Those found are ranked by the cosine of the
vectors themselves, in double precision.

The radius is measured: ``reach`` of the true neighbours of some probe vectors, searched among all rows, lie within it. The number of substrings
follows from it: short substrings are selective where neighbours are close, long ones save copies of rows where they aren't. Where
queries would probe nearly all cells of any substrings, the code stays whole: each row is stored once, and each pair is met once and told by its
Hamming distance. Queries that find fewer than ``k`` rows within the radius are compared with all rows in a second pass, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

BITS = 256
PAIRS = 1 << 20  # pairs of a query and a row that are compared at once


@dataclass
class Coder:
    """How vectors of one length become codes. ``substrings`` is 0 where all rows are compared, as few rows need no index."""

    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    radius: int
    substrings: int = 0
    prefix: int = 0  # bits of a substring that name its cell

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows x bytes."""
        return np.packbits((x / norms(x)[:, None] - self.mean) @ self.rotation > 0, axis=1, bitorder="little")

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """Rows x substrings, as numbers; a code that stays whole lies in one cell, and its first bits stand for it."""
        if self.substrings == 1:
            return codes.view("<u8")[:, :1]
        return codes.view(f"<u{codes.shape[1] // self.substrings}")

    def allowed(self) -> list[int]:
        """The most bits in which each substring may differ; -1: it needn't be probed."""
        a, b = divmod(self.radius, self.substrings)
        return [a if j <= b else a - 1 for j in range(self.substrings)]

    def cells(self, parts: np.ndarray) -> np.ndarray:
        width = 8 * parts.dtype.itemsize
        return (parts >> np.array(width - self.prefix, parts.dtype)).astype(np.int64) if self.prefix else np.zeros(parts.shape, np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, also of vectors whose squares are too small or large for a double."""
    top = np.abs(x).max(1, keepdims=True)
    return top[:, 0] * np.sqrt(((x / top) ** 2).sum(1))


def cosines(x: np.ndarray, nx: np.ndarray, q: np.ndarray, nq: np.ndarray) -> np.ndarray:
    """Row by row in one order of sums, so that equal vectors have equal cosines."""
    return ((x / nx[:, None]) * (q / nq[:, None])).sum(1)


def masks(width: int, most: int) -> np.ndarray:
    """All values of so many bits with at most ``most`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(min(most, width) + 1) for c in combinations(range(width), n)], np.int64)


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 3) -> Coder:
    """Centre and rotations; the radius is still to be measured."""
    n, dim = sample.shape
    if not n:
        return Coder(np.zeros(dim), np.eye(dim, bits), bits)
    unit = sample / norms(sample)[:, None]
    mean = unit.mean(0)
    _, vectors = np.linalg.eigh(np.cov(unit - mean, rowvar=False).reshape(dim, dim) if n > 1 else np.eye(dim))
    main = vectors[:, ::-1][:, : min(bits, dim)]
    v, turned = (unit - mean) @ main, []
    rng = np.random.default_rng(seed)
    for _ in range(-(-bits // main.shape[1])):
        r, _ = np.linalg.qr(rng.normal(size=(main.shape[1],) * 2))
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ wt).T
        turned.append(main @ r)
    return Coder(mean, np.concatenate(turned, 1)[:, :bits], bits)


def planned(coder: Coder, radius: int, rows: int, queries: int, rows_per_cell: int) -> Coder:
    """With the number of substrings that makes least work: copies of rows and queries against pairs that cells hold."""
    best = None
    for m in (m for m in (1, 4, 8, 16, 32) if coder.bits % (64 if m == 1 else 8 * m) == 0 and (m == 1 or coder.bits // m <= 64)):
        trial = replace(coder, radius=radius, substrings=m, prefix=0 if m == 1 else min(coder.bits // m, max(0, (rows // rows_per_cell).bit_length()), 20))
        probed = [sum(comb(trial.prefix, i) for i in range(min(a, trial.prefix) + 1)) for a in trial.allowed() if a >= 0]
        words = coder.bits // 64 if m == 1 else 1
        work = (m * rows + sum(probed) * queries) * 200.0 + sum(probed) / 2.0**trial.prefix * words * rows * queries
        best = min(best or (work, m, trial), (work, m, trial), key=lambda x: x[:2])
    return best[2] if best else replace(coder, radius=coder.bits)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """The places of each group's ``k`` largest scores, ties by id; with ``slack`` also those that are so little less."""
    order = np.lexsort((ids, -score, group))
    g, s = group[order], score[order]
    first = np.flatnonzero(np.diff(g, prepend=-1)) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    last = np.minimum(first + k, np.append(first[1:], len(g))) - 1
    least = np.repeat(s[last], np.diff(np.append(first, len(g))))
    return order[(rank < k) | ((s >= least - slack) if slack else False)]


def search(coder: Coder, j: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, qids: np.ndarray, q: np.ndarray, qcodes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, cosine) of each query's ``k`` best rows of a cell of substring ``j`` (-1: of all rows)."""
    nx, nq = norms(x), norms(q)
    unit, qunit = x / nx[:, None], q / nq[:, None]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), step := max(1, PAIRS // max(1, len(x)))):
        part = slice(at, at + step)
        if j < 0:
            a, b = np.divmod(np.arange(len(q[part]) * len(x)), len(x))
            a += at
            keep = ids[b] != qids[a]
        elif coder.substrings == 1:
            own, other = qcodes[part].view("<u8"), codes.view("<u8")
            far = np.zeros((len(own), len(other)), np.uint16)
            for w in range(own.shape[1]):
                far += np.bitwise_count(own[:, w, None] ^ other[None, :, w])
            a, b = np.nonzero(far <= coder.radius)
            a += at
            keep = ids[b] != qids[a]
        else:
            parts, asked, allowed = coder.parts(codes), coder.parts(qcodes), coder.allowed()
            a, b = np.nonzero(np.bitwise_count(asked[part, j, None] ^ parts[None, :, j]) <= allowed[j])
            a += at
            keep = (np.bitwise_count(qcodes.view("<u8")[a] ^ codes.view("<u8")[b]).sum(1, dtype=np.int64) <= coder.radius) & (ids[b] != qids[a])
            a, b = a[keep], b[keep]
            keep = np.ones(len(a), bool)
            for i in range(j):
                keep &= np.bitwise_count(asked[a, i] ^ parts[b, i]).astype(np.int64) > allowed[i]
        a, b = a[keep], b[keep]
        near = _best(a, np.einsum("ij,ij->i", unit[b], qunit[a]), ids[b], k, slack=1e-9)
        found.append((a[near], b[near]))
    a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    s = cosines(x[b], nx[b], q[a], nq[a])
    top = _best(a, s, ids[b], k)
    return qids[a[top]], ids[b[top]], s[top]


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _bytes(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        size = batch.column("dim").to_numpy()
        for dim in np.unique(size).tolist():
            yield dim, batch.filter(pa.array(size == dim))


def _coded(base: DataFrame, coders: dict[int, Coder]) -> DataFrame:
    """With the code of each vector; of lengths without an index it is a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_length(batches):
            coder = coders.get(dim)
            codes = coder.codes(_matrix(batch.column("v"), dim)) if coder else np.zeros((len(batch), 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "code"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields]).add("code", "binary"))


def _measured(coded: DataFrame, coders: dict[int, Coder], probes: dict[int, tuple[np.ndarray, np.ndarray]], k: int, reach: float) -> dict[int, int]:
    """Of each length the radius within which ``reach`` of the probes' true neighbours lie. Each task keeps ``k`` neighbours of each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for dim, batch in _by_length(batches):
            if dim not in probes:
                continue
            pids, p = probes[dim]
            x, ids, codes = _matrix(batch.column("v"), dim), batch.column("id").to_numpy(), _bytes(batch.column("code")).view("<u8")
            s = (p / norms(p)[:, None]) @ (x / norms(x)[:, None]).T
            s[pids[:, None] == ids[None, :]] = -2
            far = min(k, s.shape[1])
            top = np.argpartition(-s, far - 1, axis=1)[:, :far]
            a = np.repeat(np.arange(len(p)), far)
            own = coders[dim].codes(p).view("<u8")
            new = (a, np.take_along_axis(s, top, 1).ravel(), ids[top.ravel()], np.bitwise_count(own[a] ^ codes[top.ravel()]).sum(1, dtype=np.int64))
            if dim in best:
                new = tuple(np.concatenate(c) for c in zip(best[dim], new, strict=True))
            keep = _best(new[0], new[1], new[2], k)
            best[dim] = tuple(c[keep] for c in new)
        for dim, (a, s, i, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dim), pa.int32()), pa.array(a), pa.array(s), pa.array(i), pa.array(d)], names=["dim", "probe", "s", "id", "far"])

    each = coded.select("dim", "id", "v", "code").mapInArrow(run, "dim int, probe long, s double, id long, far long")
    rank = F.row_number().over(Window.partitionBy("dim", "probe").orderBy(F.desc("s"), "id"))
    near = each.filter("s > -2").withColumn("rank", rank).filter(F.col("rank") <= k)
    # At most probes x k rows.
    return {r.dim: int(np.quantile(r.far, reach, method="higher")) for r in near.groupBy("dim").agg(F.collect_list("far").alias("far")).collect()}


def _placed(rows: DataFrame, coders: dict[int, Coder], probing: bool) -> DataFrame:
    """A row for each substring in the cell of its prefix, or in every cell that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_length(batches):
            coder = coders[dim]
            cells = coder.cells(coder.parts(_bytes(batch.column("code"))))
            for j, most in enumerate(coder.allowed()):
                if most < 0:
                    continue
                flips = masks(coder.prefix, most) if probing else np.zeros(1, np.int64)
                for i in range(0, len(batch), step := max(1, 20_000 // len(flips))):
                    cell = (cells[i : i + step, j, None] ^ flips[None, :]).ravel()
                    part = batch.take(pa.array(np.repeat(np.arange(i, min(i + step, len(batch))), len(flips))))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(cell), j), pa.int32()), pa.array(cell)], names=[*part.schema.names, "j", "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add("j", "integer").add("cell", "long"))


def _met(index: DataFrame, asks: DataFrame, coders: dict[int, Coder], k: int, rows_per_cell: int, queries_per_cell: int) -> DataFrame:
    """The ``k`` best rows of each query in each cell. Cells are split by their measured sizes, so that one key may hold any share of the rows."""
    key = ["dim", "j", "cell"]
    sizes = index.groupBy(key).agg(F.count("*").alias("n")).join(asks.groupBy(key).agg(F.count("*").alias("q")), key)
    sizes = saved(sizes.select(*key, F.ceil(F.col("n") / rows_per_cell).cast("int").alias("s"), F.ceil(F.col("q") / queries_per_cell).cast("int").alias("t")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, key).select(*key, "id", "v", "code", F.pmod(F.xxhash64("id"), F.col("s")).cast("int").alias("split"), every("t").alias("part"))
    own = [F.col(c).alias(c) for c in (*key, "id", "v", "code")]  # columns of their own, as both sides may come from one table
    right = asks.join(sizes, key).select(*own, every("s").alias("split"), F.pmod(F.xxhash64("id"), F.col("t")).cast("int").alias("part"))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        dim, j = key[0].as_py(), key[1].as_py()
        cols = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(a) and len(b):
            cols = search(coders.get(dim), j, a.column("id").to_numpy(), _matrix(a.column("v"), dim), _bytes(a.column("code")), b.column("id").to_numpy(), _matrix(b.column("v"), dim), _bytes(b.column("code")), k)
        return pa.table([pa.array(c) for c in cols], names=["query_id", "id", "score"])

    unit = [*key, "split", "part"]
    return left.groupBy(unit).cogroup(right.groupBy(unit)).applyInArrow(run, "query_id long, id long, score double")


def nearest(
    df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, reach: float = 0.97, sample: int = 6000, probes: int = 200,
    rows_per_cell: int = 4096, queries_per_cell: int = 8192, few: int = 1024,
) -> DataFrame:
    """Each query's ``k`` nearest rows by cosine: query_id, rank (from 1), ``id_col``, score; ties go to the smaller id.

    ``queries`` says which rows are queries. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id. Of rows with the same id one counts (the least vector). Vectors of each length are searched among their own, those of up to ``few`` rows a
    length without an index. About ``sample`` rows of a length, chosen by a hash, teach the codes, and ``probes`` of these the
    radius; every row is indexed. Other columns aren't carried, whatever their names. An empty table gives no rows.
    """
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col("v")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), queries.alias("q")).filter(F.col("id").isNotNull() & v.isNotNull() & ok)
    base = saved(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("dim", F.size("v")))
    sizes = {r.dim: (r.n, r.q) for r in base.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("q")).collect()}
    large = {dim: n for dim, (n, q) in sizes.items() if n > few and q}
    top, coders = 1 << 30, {}
    if large:
        share = F.lit(0)
        for dim, n in large.items():
            share = F.when(F.col("dim") == dim, int(top * min(1.0, sample / n))).otherwise(share)
        chosen = base.filter(F.pmod(F.xxhash64(F.lit(43), "id"), F.lit(top)) < share).select("dim", "id", "v").collect()
        asked = {}
        for dim in large:
            got = sorted((r.id, r.v) for r in chosen if r.dim == dim)
            x = np.array([v for _, v in got], np.float64).reshape(-1, dim)
            coders[dim] = learn(x)
            pick = np.arange(len(got)) % max(1, len(got) // probes) == 0
            asked[dim] = np.array([i for i, _ in got], np.int64)[pick], x[pick]
    coded = saved(_coded(base, coders)) if large else base.withColumn("code", F.lit(b"\0"))
    if large:
        radius = _measured(coded, coders, asked, k, reach)
        coders = {dim: planned(c, radius.get(dim, c.bits), *sizes[dim], rows_per_cell) for dim, c in coders.items()}
    cols = ["dim", "id", "v", "code"]
    indexed = F.col("dim").isin([dim for dim, c in coders.items() if c.substrings])
    with_index = coded.filter(indexed)
    met = None
    if any(c.substrings for c in coders.values()):
        met = saved(_met(_placed(with_index.select(cols), coders, False), _placed(with_index.filter("q").select(cols), coders, True), coders, k, rows_per_cell, queries_per_cell))
    # Queries with fewer than k rows within the radius, and lengths without an index.
    open_ = coded.filter("q").select(cols)
    if met is not None:
        done = met.groupBy("query_id").agg(F.count("*").alias("c")).filter(F.col("c") >= k).select(F.col("query_id").alias("id"))
        open_ = saved(open_.join(done, "id", "left_anti"))
    if met is None or not open_.isEmpty():
        blocks = F.lit(0)
        for dim, (n, _) in sizes.items():
            blocks = F.when(F.col("dim") == dim, -(-n // rows_per_cell)).otherwise(blocks)
        lengths = [r.dim for r in open_.select("dim").distinct().collect()]
        all_ = coded.filter(F.col("dim").isin(lengths)).select(*cols, F.lit(-1).alias("j"), F.pmod(F.xxhash64("id"), blocks).alias("cell"))
        each = open_.select(*cols, F.lit(-1).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("cell"))
        rest = _met(all_, each, coders, k, rows_per_cell, queries_per_cell)
        met = rest if met is None else met.join(open_.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
