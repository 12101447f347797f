"""Quality of texts by positive-unlabelled learning.

A linear model over the make-up of a text (shares of character classes and of their sequences, repetition, lengths) is learned
from trusted positives and unlabelled text alone, by the non-negative unbiased risk: with class prior ``p``,
``p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])`` for the logistic loss ``l``.
Samples are bounded (``positives`` and ``unlabelled`` rows, chosen by a hash of the row).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices, utf8_parts

#: Character classes: other, lower, upper, digit, space, line end, full stop or comma, other sentence marks, quotes, brackets, bars and
#: slashes, symbols, letters beyond ASCII (their first byte), and their further bytes.
CLASSES = 14
STATS = 18


def _classes() -> np.ndarray:
    t = np.zeros(256, np.int64)
    for k, chars in enumerate(("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,", "!?;:", "'\"`", "()[]{}<>", "|/\\", "#$%&*+-=@^_~")):
        for c in chars:
            t[ord(c)] = k
    t[0xC0:] = 12
    t[0x80:0xC0] = 13
    return t


TABLE = _classes()


def features(col: pa.Array) -> np.ndarray:
    """A row of numbers for each text, from all its bytes."""
    raw, off = utf8_parts(col)
    n = len(col)
    size = np.diff(off)
    out = np.zeros((n, STATS + CLASSES + CLASSES**2), np.float32)
    if not len(raw):  # only empty texts: as below
        out[:, 10], out[:, 13] = np.log1p(1) / 5, 1
        return out
    c = TABLE[raw]
    doc = np.repeat(np.arange(n), size)
    at = STATS
    for k in (1, 2):
        code, own = c, doc
        for j in range(1, k):
            code, own = code[:-1] * CLASSES + c[j:], own[:-1]
        same = doc[: len(own)] == doc[k - 1 :]
        width = CLASSES**k
        h = np.bincount(own[same] * width + code[same], minlength=n * width).reshape(n, width)
        out[:, at : at + width] = np.sqrt(h / np.maximum(h.sum(1, keepdims=True), 1))
        at += width
    # Words: runs without white space; a hash of each tells repetition.
    solid = (c != 4) & (c != 5)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[off[:-1][size > 0]] |= solid[off[:-1][size > 0]]
    begin = np.flatnonzero(first)
    if len(begin):
        number = np.cumsum(first) - 1
        inside = np.flatnonzero(solid)
        place = (inside - begin[number[inside]]).astype(np.uint64)
        mixed = (raw[inside].astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x165667B19E3779F9)
        starts = np.flatnonzero(first[inside])
        word = np.add.reduceat(mixed, starts)
        length = np.diff(np.append(starts, len(inside)))
        own = doc[begin]
        words = np.bincount(own, minlength=n)
        least = np.maximum(words, 1)
        mean = np.bincount(own, length, n) / least
        out[:, 0] = np.log1p(words) / 10
        out[:, 1] = mean / 10
        out[:, 2] = np.sqrt(np.maximum(np.bincount(own, length.astype(float) ** 2, n) / least - mean**2, 0)) / 10
        for j, gap in ((3, 1), (4, 2), (5, 3)):
            if len(word) > gap:
                same = (word[gap:] == word[:-gap]) & (own[gap:] == own[:-gap])
                out[:, j] = np.bincount(own[gap:][same], minlength=n) / least
        key = np.lexsort((word, own))
        new = np.ones(len(key), bool)
        new[1:] = (word[key][1:] != word[key][:-1]) | (own[key][1:] != own[key][:-1])
        distinct = np.bincount(own[key][new], minlength=n)
        out[:, 6] = distinct / least
        out[:, 7] = distinct / np.maximum(1, least**0.8)
        out[:, 8] = np.bincount(own, length > 20, n) / least
        out[:, 9] = np.bincount(own, length == 1, n) / least
    lines = np.bincount(doc, c == 5, n) + 1
    out[:, 10] = np.log1p(lines) / 5
    out[:, 11] = np.log1p(size / lines) / 10
    out[:, 12] = np.log1p(size) / 15
    out[:, 13] = size == 0
    letters = np.maximum(np.bincount(doc, (c == 1) | (c == 2) | (c == 12), n), 1)
    out[:, 14] = np.bincount(doc, c == 2, n) / letters
    out[:, 15] = np.bincount(doc, c == 3, n) / np.maximum(size, 1)
    out[:, 16] = np.minimum(np.bincount(doc, (c >= 7) & (c <= 11), n) / letters, 2)
    out[:, 17] = np.minimum(np.bincount(doc, c == 6, n) / letters, 2)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def nn_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk (positives', negatives' before it is held at 0), and the slopes to minimise it at fp and fu.

    Where the negatives' part falls below 0 the model has begun to fit chance: then the step goes back along that part.
    """
    loss = lambda z: np.logaddexp(0, -z)
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -500, 500)))
    positive = prior * loss(fp).mean()
    negative = loss(-fu).mean() - prior * loss(-fp).mean()
    gp, gu = prior * slope(fp) / len(fp), -slope(-fu) / len(fu)
    back = prior * slope(-fp) / len(fp)
    if negative >= 0:
        return positive, negative, gp + back, gu
    return positive, negative, -back, -gu


def train(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 250, rate: float = 0.02, l2: float = 2e-3) -> Model:
    """Adam on the whole samples. Without positives or unlabelled rows the model scores the prior."""
    both = np.concatenate([xp, xu])
    mean = both.mean(0) if len(both) else np.zeros(xp.shape[1])
    scale = np.maximum(both.std(0), 0.02) if len(both) else np.ones(xp.shape[1])
    xp, xu = (xp - mean) / scale, (xu - mean) / scale
    start = float(np.log(prior / (1 - prior)))
    model = Model(np.zeros(xp.shape[1]), start, mean, scale, prior)
    if not len(xp) or not len(xu):
        return model
    w = np.zeros(xp.shape[1] + 1)
    w[-1] = start
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for s in range(1, steps + 1):
        _, _, gp, gu = nn_risk(xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1], prior)
        g = np.append(gp @ xp + gu @ xu + l2 * w[:-1], gp.sum() + gu.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= rate * (m1 / (1 - 0.9**s)) / (np.sqrt(m2 / (1 - 0.99**s)) + 1e-9)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def estimate_prior(sp: np.ndarray, su: np.ndarray, least: int = 50) -> float:
    """The share of positives among unlabelled rows, from a classifier's margins on positives and unlabelled rows that
    it has not learned from: of all thresholds, the least ratio of rows above it (unlabelled to positive), with bounds
    for chance, as above a good threshold unlabelled rows are positives alone.
    """
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0, 1 - min(0.9, least / max(len(sp), 1)), 200))
    qp = np.array([(sp >= c).mean() for c in cuts])
    qu = np.array([(su >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2 / len(sp)) + np.sqrt(np.log(40) / 2 / len(su))
    best = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.02, 0.98))


def _collected(rows: DataFrame) -> np.ndarray:
    """The features of a bounded sample's texts ``t``, made in tasks; in an order that partitions don't change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, col in text_slices(batches, "t", 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features(col)], pa.binary())], names=["x"])

    found = sorted(bytes(r.x) for r in rows.select("t").mapInArrow(run, "x binary").collect())
    return np.frombuffer(b"".join(found), np.float32).reshape(-1, STATS + CLASSES + CLASSES**2).astype(np.float64)


def learn(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", usable: Column | None = None, positives: int = 3000, unlabelled: int = 5000) -> Model:
    """Learn from about so many positives (label 1) and unlabelled rows of ``df``.

    ``usable`` says which rows may be learned from. Of ``labels`` only the ids of positives are used; the
    class prior is estimated from half of the samples with a model of the other half.
    """
    ok = usable if usable is not None else F.lit(True)
    top = 1 << 30

    def some(rows: DataFrame, n: int, bound: int, salt: int) -> DataFrame:
        return rows.filter(F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(top)) < F.lit(int(top * min(1.0, bound / max(n, 1)))))

    trusted = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull() & ok).select(id_col).distinct()
    chosen = some(trusted, trusted.count(), positives, 31)  # bounded by ``positives``, so that it can be broadcast
    texts = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    xp = _collected(texts.join(F.broadcast(chosen), id_col, "left_semi"))
    web = texts.filter(ok)
    xu = _collected(some(web, web.count(), unlabelled, 37))
    rng = np.random.default_rng(5)
    hp, hu = rng.permutation(len(xp)) % 2 == 0, rng.permutation(len(xu)) % 2 == 0
    found = []
    for a, b in ((hp, hu), (~hp, ~hu)):
        m = train(xp[a], xu[b], 0.5, steps=150)
        found.append(estimate_prior(m.margin(xp[~a]), m.margin(xu[~b])))
    return train(xp, xu, float(np.mean(found)))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, carry: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``id_col``, the columns of ``carry``, and the two of ``names``: a score from 0 to 1, and 1 where it is ``threshold`` or more, else 0; one row per row.

    Null texts count as empty, which have a score, too. Texts are read whole, however long. Repeated rows give equal results, null ids are kept. A carried column
    that has one of the ``names`` is left out. An empty table gives no rows.
    """
    carry = [c for c in dict.fromkeys([id_col, *(carry or [])]) if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = text_col if text_col in carry else "__text"
    rows = df.select(*carry, *([] if text_col in carry else [F.col(text_col).alias(text)]))
    schema = T.StructType([f for f in rows.schema.fields if f.name in carry]).add(names[0], "double").add(names[1], "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_slices(batches, text, 1 << 20):
            for i in range(0, len(col), 2000):
                score = shared.value.score(features(col.slice(i, 2000)))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 2000) for j in range(len(carry))), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*carry, *names])

    return rows.mapInArrow(run, schema)
