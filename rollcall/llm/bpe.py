"""Byte-level BPE encoding by tree concatenation, and decoding.

A text is cut at its middle again and again until the leaves are short. All leaves are encoded on their
own, in any order and on any machine: texts above ``chunk_chars`` are first dealt to tasks as rows.
Neighbouring halves are then joined: a window of tokens around the join is encoded again, and grows
until it agrees with both sides, so that the ids are those of the text as a whole.

Why a join is exact:

* Between a non-space character and a following white space the pre-tokenizer always ends a piece, and no
  special token holds white space. A window that reaches such a place on both sides replaces the tokens between them.
* Elsewhere (long unsplit runs) a sequence of tokens is the BPE encoding of its string if every two
  neighbours are. A window whose first token is the left side's own and whose last token is the right
  side's own makes only pairs that are valid in the left side, in the window or in the right side.

Windows start with 16 tokens a side, more than the bytes of the special token.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, text_slices, utf8_parts

SPACES = (0x20, 0x0A)
#: Fixed value: how byte-level pre-tokenizers split a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in keep}
    for n, b in enumerate(x for x in range(256) if x not in set(keep)):
        out[chr(256 + n)] = b
    return out


class Encoder:
    """Encodes many texts of a batch at once; gives exactly the ids of the tokenizers library.

    Texts are cut at places that end a piece in any context (see above); every distinct piece
    is encoded once by the library, so that its cost follows the vocabulary and not the text.
    ``kept`` bounds the pieces remembered between batches.
    """

    def __init__(self, path: str, kept: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = _id_type(size)
        added = self.tok.get_added_tokens_decoder()
        letters = _byte_alphabet()
        self.bytes: list[bytes] = [b""] * size
        for word, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = word.encode() if i in added else bytes(letters[c] for c in word)
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.text = [str(i) for i in range(size)]
        self.kept, self.cache = kept, {}
        self.special = tuple(x.content for x in added.values())
        self.ranked = self._ranked(path)
        first = np.array([x[0] if x else 0 for x in self.bytes])
        self.opens = np.isin(first, SPACES)
        self.closes = np.array([_ends_in_word(x) for x in self.bytes])

    def _ranked(self, path: str):
        """The same vocabulary as tiktoken ranks, which encode many short pieces faster; None unless the
        file's merges, in order, make the ids in order, and its pre-tokenizer is the plain byte-level one.
        """
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, pre = spec["model"].get("vocab", {}), spec["pre_tokenizer"] or {}
        merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in spec["model"].get("merges", [])]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        if not plain or not isinstance(vocab, dict) or any(vocab.get(x) != 256 + i for i, x in enumerate(merges)) or sorted(vocab.get(c, -1) for c in _byte_alphabet()) != [*range(256)]:
            return None
        ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def many(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offsets of each text's ids."""
        raw, off = utf8_parts(col)
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(col) + 1, np.int64)
        cut = np.zeros(len(raw), bool)
        space = (raw == 0x20) | (raw == 0x0A)
        before = raw[:-1]
        sure = (before > 0x20) & (before < 0x7F)
        sure[1:] |= (before[1:] >= 0x80) & (before[:-1] >= 0xC3) & (before[:-1] <= 0xDF)
        cut[1:] = space[1:] & sure
        cut[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        at = pieces.indices.to_numpy()
        words = pieces.dictionary.to_pylist()
        ids = list(map(self.cache.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            often = np.bincount(at, minlength=len(words))
            if len(self.cache) > self.kept:
                self.cache.clear()
            for i, x in zip(missing, self._pieces([words[i] for i in missing]), strict=True):
                ids[i] = x
                if often[i] > 1:
                    self.cache[words[i]] = x
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(ids), self.dtype)
        firsts = np.cumsum(counts) - counts
        each = counts[at]
        flat = pool[ragged(firsts[at], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        return flat, ends[np.searchsorted(starts, off, side="left")]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """The ids of each piece. Those that may stand beside each other are encoded many at a time."""
        blob = "".join(words)
        special = [t for t in self.special if t in blob]
        beside = [x[0] in " \n" and ("!" <= x[-1] <= "~" or "\xc0" <= x[-1] <= "\u07ff") and not (special and any(t in x for t in special)) for x in words]
        many = [x for x, ok in zip(words, beside, strict=True) if ok]
        alone = iter(self.tok.encode_batch([x for x, ok in zip(words, beside, strict=True) if not ok], add_special_tokens=False))
        if self.ranked:
            found = [self.ranked.encode_to_numpy("".join(many[i : i + 5000]), disallowed_special=()).astype(self.dtype) for i in range(0, len(many), 5000)]
        else:
            texts = ["".join(many[i : i + 64]) for i in range(0, len(many), 64)]
            found = [np.array(e.ids, self.dtype) for i in range(0, len(texts), 1000) for e in self.tok.encode_batch(texts[i : i + 1000], add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, self.dtype), *found])
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in many), np.int64, len(many)))
        at = np.concatenate([[0], np.searchsorted(np.cumsum(self.size[flat]), ends) + 1]) * self.dtype.itemsize
        raw, cuts = flat.tobytes(), iter(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return [raw[slice(*next(cuts))] if ok else np.array(next(alone).ids, self.dtype).tobytes() for ok in beside]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of two neighbouring parts' whole text."""
        if not len(a) or not len(b):
            return b if not len(a) else a
        n = 16
        while True:
            left, right = max(0, len(a) - n), min(len(b), n)
            if self.opens[b[0]] and self.closes[a[-1]]:
                return np.concatenate([a, b])
            tail, head = a[left:], b[:right]
            i = np.flatnonzero(self.opens[tail[1:]] & self.closes[tail[:-1]])
            j = np.flatnonzero(self.opens[head[1:]] & self.closes[head[:-1]])
            x = left + 1 + int(i[-1]) if len(i) else left
            y = int(j[0]) + 1 if len(j) else right
            window = self.decode(a[x:].tolist()) + self.decode(b[:y].tolist())
            try:
                mid = self.one(window.decode())
            except UnicodeDecodeError:  # a token ends within a character: take one more
                n += 1
                continue
            n *= 2
            if not (len(i) or not left or mid[0] == a[x]):
                continue
            if len(j) or right == len(b):
                return np.concatenate([a[:x], mid, b[y:]])
            # The end of the window may lack what follows: agree on a token before its last 16 bytes.
            here, there = np.cumsum(self.size[mid]), int(self.size[a[x:]].sum()) + np.cumsum(self.size[head])
            k = np.searchsorted(here, there)
            same = (here[k] == there) & (mid[k] == head) & (there <= len(window) - 16)
            if same.any():
                q = int(np.argmax(same))
                return np.concatenate([a[:x], mid[: k[q] + 1], b[q + 1 :]])

    def tree(self, leaves: list[np.ndarray]) -> np.ndarray:
        """Join neighbours pairwise until one is left."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else np.zeros(0, self.dtype)

    def many_by_tree(self, col: pa.Array, leaf_bytes: int) -> Iterator[np.ndarray]:
        """The ids of each text, from leaves of about ``leaf_bytes``."""
        raw, off = utf8_parts(col)
        cuts, owners = [], np.zeros(len(col), np.int64)
        for k in range(len(col)):
            a, b = int(off[k]), int(off[k + 1])
            n = 1
            while (b - a) / n > leaf_bytes:
                n *= 2
            at = [a]
            for q in range(1, n):
                p = a + (b - a) * q // n
                while p > a and (raw[p] & 0xC0) == 0x80:  # not within a character
                    p -= 1
                if p > at[-1]:
                    at.append(p)
            owners[k] = len(at)
            cuts += at
        bounds = np.append(np.array(cuts, np.int64), len(raw))
        leaves = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
        ids, ends = self.many(leaves)
        first = 0
        for n in owners.tolist():
            yield self.tree([ids[ends[i] : ends[i + 1]] for i in range(first, first + n)])
            first += n


def _ends_in_word(x: bytes) -> bool:
    """Whether the last character is surely no white space."""
    return bool(x) and (0x20 < x[-1] < 0x7F or len(x) > 1 and x[-1] >= 0x80 and 0xC3 <= x[-2] <= 0xDF)


def _id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


@lru_cache(4)
def id_type(path: str) -> np.dtype:
    """How the ids of a vocabulary are stored; without loading all that encoding takes."""
    from tokenizers import Tokenizer

    return _id_type(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, chunk_chars: int = 32_768, leaf_bytes: int = 4096) -> DataFrame:
    """Columns ``id_col`` and ``ids`` (binary, little-endian unsigned; 2 bytes an id, or 4 for over 65,536 ids), one row per row.

    Texts above ``chunk_chars`` are cut into chunks that any task may take; each is encoded as a tree, and the
    chunks' ids meet again by text. Null texts count as empty and give no ids. Rows with a null id are
    kept. Repeated rows give as many rows. Other columns are not carried, so that none can clash. An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch, col in text_slices(batches, "text", 2 << 20):
            ids = [x.tobytes() for x in e.many_by_tree(col, leaf_bytes)]
            others = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(ids, pa.binary())], names=[*names, "ids"])

    kind = dict(rows.dtypes)["id"]
    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(whole, f"id {kind}, ids binary")

    long = rows.filter(F.length("text") > chunk_chars).withColumn("h", F.sha2("text", 256))
    parts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk_chars).cast("int"))
    chunks = (
        long.select("id", "h", F.posexplode(F.transform(parts, lambda k: F.substring("text", k * chunk_chars + 1, F.lit(chunk_chars)))).alias("part", "text"))
        .groupBy("id", "h", "part")  # deals the chunks; repeated rows are encoded once
        .agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        .mapInArrow(whole, f"id {kind}, h string, part int, copies long, ids binary")
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        e = encoder(path)
        one = pdf.sort_values("part")
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "copies": [int(pdf["copies"].iloc[0])], "ids": [e.tree([np.frombuffer(x, e.dtype) for x in one["ids"]]).tobytes()]})

    met = chunks.groupBy("id", "h").applyInPandas(meet, f"id {kind}, copies long, ids binary")
    met = met.select("id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id", "ids")
    return short.unionByName(met).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Of rows of :func:`encode`: n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_py(), e.dtype).tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(e.text.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 0, size: int = 1024) -> DataFrame:
    """Every row's ids, with ``end_id`` behind each text, in pieces of at most ``size``: ``id``, ``start`` (ids before the piece), ``total`` (ids of
    the row) and ``ids`` (binary); for packing. Null texts count as empty.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        wide = e.dtype.itemsize
        tail = b"" if end_id is None else np.array([end_id], e.dtype).tobytes()
        for batch, col in text_slices(batches, "text", 2 << 20):
            ids, at = e.many(col)
            raw, at = ids.tobytes(), (at * wide).tolist()
            owner, start, total, pieces = [], [], [], []
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                row = raw[a:b] + tail
                for s in range(0, max(len(row), 1), size * wide):
                    owner.append(k)
                    start.append(s // wide)
                    total.append(len(row) // wide)
                    pieces.append(row[s : s + size * wide])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(pieces, pa.binary())], names=["id", "start", "total", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, start long, total long, ids binary")
