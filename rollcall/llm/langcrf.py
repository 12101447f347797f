"""Language of texts by a linear-chain conditional random field over words.

Emissions come from affixes, character n-grams and lexicons, transitions are learned, and forward-backward gives
each word's language, also where a text changes between languages. A text's language is the one with the
most letters in it.

The model is learned from a bounded sample of labelled rows (``per_lang`` rows a language, chosen by a hash of the
row); their words are spliced into code-switched sequences, so that transitions can be learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices, utf8_parts

BITS = 18
LETTER = re.compile(r"[^\W\d_]")
MARK = 2
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(col: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-cased words: each one's number, the distinct words, and where each text's words start (and end)."""
    raw, off = utf8_parts(pc.utf8_lower(col))
    if not len(raw):
        return np.zeros(0, np.int64), [], np.zeros(len(off), np.int64)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 0x80)
    cut = np.ones(len(raw), bool)
    cut[1:] = letter[1:] != letter[:-1]
    cut[off[:-1][off[:-1] < len(raw)]] = True
    starts = np.flatnonzero(cut)
    keep = np.flatnonzero(letter[starts])
    bounds = np.append(starts, len(raw)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))).take(pa.array(keep)).dictionary_encode()
    return pieces.indices.to_numpy().astype(np.int64), pieces.dictionary.to_pylist(), np.searchsorted(starts[keep], off)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every affix and n-gram, sorted by word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = c == MARK
    word = np.cumsum(mark) - 1
    n = len(c)
    found = []

    def add(at, owner, size, salt):
        h = np.full(len(at), salt, np.uint64) * _K[4]
        for j in range(size):
            h ^= (c[at + j] + np.uint64(j + 1)) * _K[j]
            h = (h ^ (h >> np.uint64(29))) * _K[4]
        found.append((owner, (h >> np.uint64(64 - BITS)).astype(np.int64)))

    one = np.flatnonzero(~mark)
    add(one, word[one], 1, 1)
    two = np.flatnonzero(~(mark[:-1] & mark[1:]))
    add(two, word[two], 2, 2)
    three = np.flatnonzero(~mark[1:-1])
    add(three, word[three + 1], 3, 3)
    begin = np.flatnonzero(mark)[:-1]
    size = np.diff(np.flatnonzero(mark)) - 1
    for k in (3, 4):
        ok = np.flatnonzero(size >= k)
        add(begin[ok] + 1, ok, k, 4)
        add(begin[ok] + 1 + size[ok] - k, ok, k, 5)
    owner, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owner, kind="stable")
    del n
    return owner[order], bucket[order]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages
    lexicon: dict[str, int]  # the word's row in ``known``
    known: np.ndarray  # words x languages: whose lexicons have the word
    lex_weights: np.ndarray  # languages x languages
    bias: np.ndarray
    transitions: np.ndarray  # log scores, from x to

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.tile(self.bias, (len(words), 1)).astype(np.float64)
        owner, bucket = features_of(words)
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
        return out + self.members(words) @ self.lex_weights

    def members(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        out = np.zeros((len(words), len(self.langs)))
        out[at >= 0] = self.known[at[at >= 0]]
        return out


def marginals(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each word's chances of each label. ``emit``: log scores; ``starts``: where sequences begin; also the expected
    transitions, summed, if ``pairs``.

    The whole is one chain that forgets at each start. It is cut into equal stretches: products of their
    matrices, of all stretches at once, carry forward and backward messages over the cuts.
    """
    n, k = emit.shape
    if not n:
        return emit, np.zeros((k, k)) if pairs else None
    span = int(min(512, max(16, n**0.5 / 4)))
    rows = -(-n // span)
    e = np.ones((rows * span, k))
    e[:n] = np.exp(emit - emit.max(1, keepdims=True))
    reset = np.zeros(rows * span, bool)
    reset[starts[starts < n]] = True
    reset[0] = True
    reset[n:] = True
    e, reset = e.reshape(rows, span, k), reset.reshape(rows, span)
    t = np.exp(trans - trans.max())

    def step(m, i):
        """m (rows, ..., k) times the matrix of word i."""
        out = m @ t
        r = reset[:, i]
        if r.any():
            out[r] = m[r].sum(-1, keepdims=True) / k
        out *= e[:, i].reshape(rows, *[1] * (m.ndim - 2), k)
        return out

    m = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for i in range(span):
        m = step(m, i)
        m /= m.sum((1, 2), keepdims=True)
    into = np.empty((rows, k))
    back = np.empty((rows, k))
    a = np.full(k, 1 / k)
    for r in range(rows):
        into[r] = a
        a = a @ m[r]
        a = a / a.sum()
    b = np.ones(k)
    for r in range(rows - 1, -1, -1):
        back[r] = b
        b = m[r] @ b
        b = b / b.sum()
    alpha = np.empty((rows, span, k))
    a = into
    for i in range(span):
        a = step(a, i)
        a /= a.sum(1, keepdims=True)
        alpha[:, i] = a
    out = np.empty((rows, span, k))
    total = np.zeros((k, k)) if pairs else None
    b = back
    for i in range(span - 1, -1, -1):
        g = alpha[:, i] * b
        out[:, i] = g / g.sum(1, keepdims=True)
        be = b * e[:, i]
        if pairs:
            prev = alpha[:, i - 1] if i else into
            x = prev[:, :, None] * t[None] * be[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            total += x[~reset[:, i]].sum(0)
        nxt = be @ t.T
        r = reset[:, i]
        if r.any():
            nxt[r] = be[r].sum(1, keepdims=True) / k
        b = nxt / nxt.sum(1, keepdims=True)
    return out.reshape(-1, k)[:n], total


def train(texts: list[str], labels: list[str], steps: int = 20, rate: float = 0.08, seed: int = 11) -> Model:
    """Learn from whole texts and their languages."""
    langs = sorted(set(labels))
    k = len(langs)
    at, words, off = words_of(pa.array(texts, pa.string()))
    label = np.repeat([langs.index(x) for x in labels], np.diff(off)) if len(texts) else np.zeros(0, np.int64)
    # Lexicons: words that are frequent in a language, and at least as frequent there as elsewhere.
    seen = np.bincount(at * max(k, 1) + label, minlength=len(words) * k).reshape(len(words), k) if k else np.zeros((0, 0))
    known = np.zeros(seen.shape, bool)
    for j in range(k):
        top = np.argsort(-seen[:, j], kind="stable")[:2000]
        known[top, j] = (seen[top, j] >= 3) & (seen[top, j] * 2 >= seen[top].sum(1))
    listed = np.flatnonzero(known.any(1))
    # Code-switched sequences: stretches of 3 to 60 words, dealt anew.
    rng = np.random.default_rng(seed)
    cuts = np.concatenate([[0], np.cumsum(rng.integers(3, 61, size=max(1, len(at) // 20)))])
    cuts = np.unique(np.concatenate([cuts[cuts < len(at)], off[:-1][np.diff(off) > 0]]))
    ends = np.append(cuts[1:], len(at))
    order = rng.permutation(len(cuts))
    # Half of the stretches are followed by their own text's next one, as most texts keep their language.
    order = np.where(rng.random(len(cuts)) < 0.5, np.minimum(np.roll(order, 1) + 1, len(cuts) - 1), order) if len(cuts) else order
    pick = np.concatenate([np.arange(cuts[i], ends[i]) for i in order]) if len(cuts) else np.zeros(0, np.int64)
    w, y = at[pick], label[pick]
    starts = np.arange(0, len(w), 200)
    model = Model(langs, np.zeros((1 << BITS, k)), {words[i]: n for n, i in enumerate(listed.tolist())}, known[listed], np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    owner, bucket = features_of(words)
    member = model.members(words)
    true = np.zeros((len(words), k))
    np.add.at(true, (w, y), 1)
    inner = np.ones(len(w), bool)
    inner[starts] = False
    follow = np.zeros((k, k))
    np.add.at(follow, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    params = [model.weights, model.lex_weights, model.bias, model.transitions]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    size = max(1, len(w))
    for s in range(1, steps + 1 if len(w) else 1):
        emit = model.emissions(words)[w]
        p, pairs = marginals(emit, starts, model.transitions, pairs=True)
        diff = np.stack([np.bincount(w, p[:, j], len(words)) for j in range(k)], 1) - true
        g = np.stack([np.bincount(bucket, diff[owner, j], 1 << BITS) for j in range(k)], 1)
        grads = [g / size + 1e-7 * model.weights, member.T @ diff / size, diff.sum(0) / size, (pairs - follow) / size]
        for q, (x, d) in enumerate(zip(params, grads, strict=True)):
            m1[q] = 0.9 * m1[q] + 0.1 * d
            m2[q] = 0.99 * m2[q] + 0.01 * d * d
            x -= rate * (m1[q] / (1 - 0.9**s)) / (np.sqrt(m2[q] / (1 - 0.99**s)) + 1e-9)
    model.weights = model.weights.astype(np.float32)
    return model


class Labeller:
    """Scores texts; remembers emissions of words seen often (``kept`` at most)."""

    def __init__(self, model: Model, kept: int = 300_000):
        self.model, self.kept, self.cache = model, kept, {}
        self.table = np.zeros((0, len(model.langs)))

    def emissions(self, words: list[str], often: np.ndarray) -> np.ndarray:
        if len(self.cache) > self.kept:
            self.cache, self.table = {}, self.table[:0]
        at = np.fromiter((self.cache.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        out = np.empty((len(words), len(self.model.langs)))
        out[at >= 0] = self.table[at[at >= 0]]
        out[new] = self.model.emissions([words[i] for i in new.tolist()])
        keep = new[often[new] > 1]
        for j, i in enumerate(keep.tolist(), len(self.table)):
            self.cache[words[i]] = j
        self.table = np.concatenate([self.table, out[keep]])
        return out

    def shares(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Each text's letters by language (as shares), each word's chances, and the words."""
        k = len(self.model.langs)
        at, words, off = words_of(col)
        if not k or not len(at):
            return np.zeros((len(col), k)), np.zeros((len(at), k)), words, at
        emit = self.emissions(words, np.bincount(at, minlength=len(words)))[at]
        p, _ = marginals(emit, off[:-1][np.diff(off) > 0], self.model.transitions)
        size = np.fromiter(map(len, words), np.float64, len(words))[at]
        total = np.zeros((len(col) + 1, k))
        have = np.flatnonzero(np.diff(off) > 0)
        total[have] = np.add.reduceat(p * size[:, None], off[have], axis=0)
        total = total[:-1]
        return total / np.maximum(total.sum(1, keepdims=True), 1e-300), p, words, at


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", keys: Column | None = None, per_lang: int = 120) -> Model:
    """Learn from about ``per_lang`` rows of each language (a hash of ``keys`` chooses); rows without text or language don't count.

    With no labelled row the model knows no language, and every prediction is ``und``.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    chance = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        chance = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_lang / n))).otherwise(chance)
    number = F.pmod(F.xxhash64(F.lit(29), keys if keys is not None else F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(number < chance).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).collect()
    sample.sort(key=lambda r: (r.l, r.t))
    return train([r.t for r in sample], [r.l for r in sample])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``id_col``, the columns of ``carry``, and the two of ``names``: the language and its share of the letters (0 to 1), one row per row.

    ``und`` with score 0 for null texts and texts without a letter; of languages with equal shares the first by name. Texts are read whole, however
    long. Repeated rows give equal results, null ids are kept. A carried column that has one of the ``names`` is left out. An empty table gives no rows.
    """
    carry = [c for c in dict.fromkeys([id_col, *(carry or [])]) if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = text_col if text_col in carry else "__text"
    rows = df.select(*carry, *([] if text_col in carry else [F.col(text_col).alias(text)]))
    schema = T.StructType([f for f in rows.schema.fields if f.name in carry]).add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(shared.value)
        for batch, col in text_slices(batches, text, 2 << 20):
            share, _, _, _ = lab.shares(col)
            best = share.argmax(1) if share.shape[1] else np.zeros(len(col), np.int64)
            lang, score = [], []
            for t, b, s in zip(col.to_pylist(), best.tolist(), share.tolist(), strict=True):
                known = bool(s) and sum(s) > 0 and LETTER.search(t) is not None
                lang.append(lab.model.langs[b] if known else "und")
                score.append(min(1.0, s[b]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*carry, *names])

    return rows.mapInArrow(run, schema)
