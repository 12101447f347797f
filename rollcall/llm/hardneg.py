"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves, each with a codebook; a pair of centroids, one of each half, names a cell. Rows of a cell lie together in segments, which
know how far their rows are from the two centroids. A query's inner product with a row of a cell is at most the sum of two half scores: the
product of the query's half with the centroid, plus the half's length times the radius. So the halves are sorted by their half scores once, and a heap goes
through the cells in order of the sum (the multi-sequence algorithm). A query stops when no further cell can hold a row of its window that beats the
last of its results: then they are certain, ties included. Cells all of whose rows lie above the window are passed over.

Each query's cells are taken from its heap in steps of growing size; the cells of a step are measured segment by segment against all queries
that ask for them, in whole numbers. Queries are taken in blocks of a bounded size, which all tasks get; rows are never copied, and each task
sends no more than the best few of each query. Positives come first; their scores are the windows of the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import few_rows, finite, saved, whole

MOST = 1 << 24  # a component's size, so that products of up to 32,768 components fit a long
EXACT = 1 << 53
SEGMENT = 512


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exactly; in floating point where that is exact."""
    size = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if size < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Page:
    """Segments of one vector length that are searched together."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], rows: list[dict]):
        self.h = books[0].shape[1]
        dim = self.h + books[1].shape[1]
        self.v = [np.frombuffer(r["v"], np.int32).reshape(-1, dim).astype(np.int64) for r in rows]
        self.ids = [np.array(r["ids"], np.int64) for r in rows]
        self.labels = [np.array(r["labels"], np.int64) for r in rows]
        self.cell = np.array([(r["a"], r["b"]) for r in rows], np.int64).reshape(-1, 2)
        self.radius = np.array([(r["ra"], r["rb"]) for r in rows]).reshape(-1, 2)
        self.books = books
        # Of each half the centroids that occur, and the largest radius of their segments.
        self.names, self.reach = [], []
        for side in (0, 1):
            names, at = np.unique(self.cell[:, side], return_inverse=True)
            reach = np.zeros(len(names))
            np.maximum.at(reach, at, self.radius[:, side])
            self.names.append(names)
            self.reach.append(reach)
        self.segments: dict[tuple[int, int], list[int]] = {}
        for s, (a, b) in enumerate(self.cell.tolist()):
            self.segments.setdefault((a, b), []).append(s)

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Half scores of the centroids, and the largest and smallest product with a row of each segment; queries x centroids or segments."""
        halves, scores, most, least = (q[:, : self.h], q[:, self.h :]), [], 0.0, 0.0
        for side in (0, 1):
            x = halves[side].astype(np.float64)
            dots, size = x @ self.books[side].T, np.sqrt((x * x).sum(1))[:, None]
            names, spread = self.names[side], size * self.radius[None, :, side]
            # Wider by what rounding may take away.
            slack = 1e-9 * (np.abs(dots).max(1, initial=0)[:, None] + size * (1 + self.radius[:, side].max(initial=0))) + 1e-6
            scores.append(dots[:, names] + size * self.reach[side][None, :] + slack)
            most = most + dots[:, self.cell[:, side]] + spread + slack
            least = least + dots[:, self.cell[:, side]] - spread - slack
        return scores, most, least


def sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs of places of two arrays by their sum, largest first: (sum, place in a, place in b)."""
    oa, ob = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    x, y = a[oa].tolist(), b[ob].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)] if x and y else []
    while heap:
        s, i, j = heappop(heap)
        yield -s, oa[i], ob[j]
        if j + 1 < len(y):
            heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class Asked:
    """Queries, and their windows (``units``): each wants the ``k`` best rows with ``low <= score <= high``, of the query's label or of others."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, unit_query: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.q, self.unit_query, self.low, self.high, self.same, self.k = ids, labels, q, unit_query, low, high, same, k
        self.unit = np.zeros(0, np.int64)  # what is found so far, by unit and order
        self.score = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        order = np.argsort(unit_query, kind="stable")
        self.starts = np.searchsorted(unit_query[order], np.arange(len(ids) + 1))
        self.units = order
        self.asking = np.unique(unit_query)

    def needs(self) -> np.ndarray:
        """The least score that still matters to each query."""
        need = self.low.astype(np.float64)
        counts = np.bincount(self.unit, minlength=len(need))
        full = np.flatnonzero(counts >= self.k)
        ends = np.cumsum(counts)
        need[full] = np.maximum(need[full], self.score[ends[full] - 1]) if len(full) else need[full]
        out = np.full(len(self.ids), np.inf)
        np.minimum.at(out, self.unit_query, need)
        return out

    def tops(self) -> np.ndarray:
        out = np.full(len(self.ids), -np.inf)
        np.maximum.at(out, self.unit_query, self.high.astype(np.float64))
        return out

    def take(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Keep the best of what was found, unit by unit."""
        n = self.starts[query + 1] - self.starts[query]
        at = np.repeat(np.arange(len(query)), n)
        unit = self.units[np.repeat(self.starts[query] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(len(at))] if len(at) else np.zeros(0, np.int64)
        inside = (score[at] >= self.low[unit]) & (score[at] <= self.high[unit])
        unit, score, row = (np.concatenate(c) for c in ((self.unit, unit[inside]), (self.score, score[at][inside]), (self.row, row[at][inside])))
        order = np.lexsort((row, -score, unit))
        unit = unit[order]
        rank = np.arange(len(unit)) - np.searchsorted(unit, unit)
        keep = order[rank < self.k]
        self.unit, self.score, self.row = unit[rank < self.k], score[keep], row[keep]


def search(page: Page, asked: Asked, step: int = 2048, log: list[int] | None = None) -> None:
    """Add the page's rows to what is found. ``log`` receives the number of pairs of a query and a row that were measured."""
    if not len(asked.asking) or not len(page.v):
        return
    scores, most, least = page.bounds(asked.q)
    names = [n.tolist() for n in page.names]
    most, least, tops = most.tolist(), least.tolist(), asked.tops().tolist()
    open_ = {i: sequence(scores[0][i], scores[1][i]) for i in asked.asking.tolist()}
    while open_:
        needs = asked.needs().tolist()
        wanted: dict[int, list[int]] = {}
        for i, cells in list(open_.items()):
            need, top, gathered, up, down = needs[i], tops[i], 0, most[i], least[i]
            while gathered < step:
                cell = next(cells, None)
                if cell is None or cell[0] < need:  # the heap is empty, or what is found is certain
                    del open_[i]
                    break
                for s in page.segments.get((names[0][cell[1]], names[1][cell[2]]), ()):
                    if up[s] >= need and down[s] <= top:
                        wanted.setdefault(s, []).append(i)
                        gathered += len(page.ids[s])
        floor, ceiling = np.array(needs), np.array(tops)
        found: list[tuple[np.ndarray, ...]] = []
        for s, who in wanted.items():
            i = np.array(who, np.int64)
            p = products(asked.q[i], page.v[s])
            same = asked.labels[i][:, None] == page.labels[s][None, :]
            ok = (p >= floor[i][:, None]) & (p <= ceiling[i][:, None]) & (same & (asked.ids[i][:, None] != page.ids[s][None, :]) if asked.same else ~same)
            x, y = np.nonzero(ok)
            found.append((i[x], p[x, y], page.ids[s][y]))
            if log is not None:
                log.append(p.size)
        if found:
            asked.take(*(np.concatenate(c) for c in zip(*found, strict=True)))
        step *= 2


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of a sample of half vectors."""
    if not x.shape[1] or not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


Books = dict[int, tuple[np.ndarray, np.ndarray]]


def learn(rows: DataFrame, sizes: dict[int, int], sample: int, per_cell: int) -> Books:
    """Two codebooks for each vector length, from about ``sample`` rows of it, chosen by a hash; their size grows with the square root of the rows, up to 256."""
    top, share = 1 << 30, F.lit(0)
    for dim, n in sizes.items():
        share = F.when(F.col("dim") == dim, int(top * min(1.0, sample / n))).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(47), "id"), F.lit(top)) < share).select("dim", "id", "v").collect()
    out = {}
    for dim, n in sizes.items():
        got = sorted((r.id, r.v) for r in chosen if r.dim == dim)
        x, h = np.array([v for _, v in got], np.float64).reshape(-1, dim), dim // 2
        k = min(256, max(1, ceil(sqrt(n / per_cell))))
        out[dim] = (codebook(x[:, :h], k), codebook(x[:, h:], k))
    return out


def index(rows: DataFrame, books: Books, tasks: int) -> DataFrame:
    """Segments (dim, a, b, ids, labels, v, ra, rb): rows of one cell, and their largest distances from its centroids. Rows are dealt by ranges of (cell, id), so that a large cell has several tasks."""
    kinds = "dim int, id long, label long, v array<long>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x, h = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), dim // 2
                cell = [pa.array(nearest(half, book).astype(np.int32)) for half, book in zip((x[:, :h], x[:, h:]), books[dim], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cell], names=[*part.schema.names, "a", "b"])

    placed = rows.select("dim", "id", "label", "v").mapInArrow(place, f"{kinds}, a int, b int")
    sorted_ = placed.repartitionByRange(tasks, "dim", "a", "b", "id").sortWithinPartitions("dim", "a", "b", "id")

    def segment(key: tuple, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        dim, a, b = key
        x = np.concatenate([p.column("v").flatten().to_numpy(zero_copy_only=False) for p in batches]).reshape(-1, dim)
        h, far = dim // 2, []
        for half, centroid in zip((x[:, :h], x[:, h:]), (books[dim][0][a], books[dim][1][b]), strict=True):
            far.append(float(np.sqrt(np.square(half - centroid).sum(1)).max(initial=0)) * (1 + 1e-9) + 1e-9)
        of = lambda c: [v for p in batches for v in p.column(c).to_pylist()]
        cols = [pa.array([dim], pa.int32()), pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([of("id")], pa.list_(pa.int64())), pa.array([of("label")], pa.list_(pa.int64())), pa.array([x.astype(np.int32).tobytes()]), pa.array([far[0]]), pa.array([far[1]])]
        return pa.RecordBatch.from_arrays(cols, names=["dim", "a", "b", "ids", "labels", "v", "ra", "rb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, size = [], None, 0
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("dim", "a", "b")], 1)
            cuts = [0, *(np.flatnonzero(np.diff(names, axis=0).any(1)) + 1).tolist(), len(names)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                while i < j:
                    if held and (key != tuple(names[i].tolist()) or size >= SEGMENT):
                        yield segment(key, held)
                        held, size = [], 0
                    n = min(j - i, SEGMENT - size)
                    key, size = tuple(names[i].tolist()), size + n
                    held.append(batch.slice(i, n))
                    i += n
        if held:
            yield segment(key, held)

    return sorted_.mapInArrow(run, "dim int, a int, b int, ids array<long>, labels array<long>, v binary, ra double, rb double")


def _searched(segments: DataFrame, books: Books, asked: dict[int, tuple], same: bool, k: int, page_rows: int) -> DataFrame:
    """(dim, unit, id, score): the best of each task's pages for each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {dim: Asked(*a, same, k) for dim, a in asked.items()}
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if (dim := r["dim"]) not in state:
                    continue
                rows = held.setdefault(dim, [])
                rows.append(r)
                if sum(len(x["ids"]) for x in rows) >= page_rows:
                    search(Page(books[dim], held.pop(dim)), state[dim])
        for dim, rows in held.items():
            search(Page(books[dim], rows), state[dim])
        for dim, s in state.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s.unit), dim, np.int32)), pa.array(s.unit), pa.array(s.row), pa.array(s.score)], names=["dim", "unit", "id", "score"])

    each = segments.mapInArrow(run, "dim int, unit long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("dim", "unit").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = 8192, per_cell: int = 256,
    block: int = 4096, page_rows: int = 1 << 15, rows_per_task: int = 1 << 16,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` says which rows are anchors. A row's score is its inner product with the anchor, components being ``floor(scale * x)``; higher scores come first,
    ties by the smaller id. An anchor's positives are its first other rows of the same label; each has the first rows of other labels whose score is from
    ``low`` to ``high`` hundredths of the positive's. Anchors without positives, and positives whose window is empty, have no rows.

    Rows without an id or label, and vectors that are null, empty, or hold a null or non-finite component, take no part. Of rows with the same id one
    counts (the least label, then vector). Rows are compared with those of their own length. Other columns aren't carried, whatever their
    names. An empty table gives no rows. Components beyond ``2^24`` after scaling are an error.
    The codebooks are learned from about ``sample`` rows a length; every row is indexed, and results are exact. Anchors go in blocks of about ``block``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).withColumn("v", whole(F.col("v"), scale, MOST))
    once = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("q").alias("q"))
    base = saved(once.select("id", F.col("r.label").alias("label"), F.col("r.v").alias("v"), "q", F.size("r.v").alias("dim")))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sizes = {r.dim: (r.n, r.q) for r in base.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("q")).collect()}
    sizes = {dim: x for dim, x in sizes.items() if x[1]}
    if not sizes:
        return spark.createDataFrame([], kinds)
    searched = base.filter(F.col("dim").isin(list(sizes)))
    books = learn(searched, {dim: n for dim, (n, _) in sizes.items()}, sample, per_cell)
    total, queries = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_task))
    with few_rows(spark, 4096):
        segments = saved(index(searched, books, tasks))
    blocks, out = -(-queries // block), f"{shared_dir(spark)}/negatives-{id(base):x}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    least, largest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for b in range(blocks):
        # A bounded block of anchors; then their positives, and the windows that follow.
        got = searched.filter("q").filter(F.pmod(F.xxhash64(F.lit(53), "id"), F.lit(blocks)) == b).select("dim", "id", "label", "v").collect()
        asked = {}
        for dim in {r.dim for r in got}:
            own = [r for r in got if r.dim == dim]
            n = len(own)
            asked[dim] = (np.array([r.id for r in own], np.int64), np.array([r.label for r in own], np.int64), np.array([r.v for r in own], np.int64).reshape(-1, dim), np.arange(n), np.full(n, least), np.full(n, largest))
        if not asked:
            continue
        with few_rows(spark, 64):
            found = _searched(segments, books, asked, True, positives, page_rows).collect()
            windows, pairs = {}, []
            for dim, (ids, labels, q, *_) in asked.items():
                own = sorted((r.unit, r.rank, r.id, r.score) for r in found if r.dim == dim and -(-low * r.score // 100) <= high * r.score // 100)
                windows[dim] = (ids, labels, q, np.array([x[0] for x in own], np.int64), np.array([-(-low * x[3] // 100) for x in own], np.int64), np.array([high * x[3] // 100 for x in own], np.int64))
                pairs += [(dim, u, int(ids[x[0]]), x[2], x[3]) for u, x in enumerate(own)]
            if not pairs:
                continue
            of = spark.createDataFrame(pairs, "dim int, unit long, anchor_id long, positive_id long, positive_score long")
            negative = _searched(segments, books, windows, False, negatives, page_rows).join(F.broadcast(of), ["dim", "unit"])  # at most block x positives rows
            negative.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    try:
        return spark.read.schema(kinds).parquet(out)
    except Exception as e:  # nothing was written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kinds)


#: The contract's query: every anchor against every row.
SQL = """WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS s FROM kept a JOIN kept r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, s AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score QUALIFY rank <= 10"""
