"""Packing of token ids into sequences of a fixed length.

``first_fit_decreasing`` keeps a tournament tree of bin capacities, ``best_fit_decreasing`` a segment tree
over the capacities themselves. Documents are cut into pieces of at most a sequence before they are shuffled; pieces are dealt
at random into groups, by a hash of a running number, so that equal rows are spread like all others. Pieces are written with their group before they are
shuffled, so that a task that runs again, after a lost executor, deals none anew. A group holds about ``docs_per_group``
pieces, hence at most about so many sequences, whatever the table's size and the documents' lengths; each is packed on its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_tokenizer, id_type, token_rows
from .common import give_back, saved


def _grouped(df: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int, docs_per_group: int, end_id: int | None) -> DataFrame:
    """``id``, ``start``, ``total`` (the document's ids) and ``ids`` of every piece, and its group ``g``."""
    least = F.coalesce(F.sum(F.ceil((F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1) / F.lit(4 * size))), F.lit(0)).alias("n")
    groups = max(1, -(-df.agg(least).first().n // docs_per_group))  # about four bytes an id
    rows = token_rows(df, id_col, text_col, tokenizer, end_id, size)
    return saved(rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(17)), F.lit(groups))))


class Tournament:
    """The first bin with room, in log time: each node holds the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.top = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        top, i = self.top, 1
        while i < self.leaves:
            i *= 2
            if top[i] < size:
                i += 1
        found = i - self.leaves
        top[i] -= size
        while i > 1:
            i //= 2
            top[i] = max(top[2 * i], top[2 * i + 1])
        return found


class Capacities:
    """The bin with least room that is enough: a segment tree counts the bins of each capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i //= 2

    def _least(self, size: int) -> int:
        """The smallest capacity of at least ``size`` that some bin has, or -1."""
        i, count = size + self.leaves, self.count
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not count[i]:
                        i += 1
                return i - self.leaves
            i //= 2
        return -1

    def take(self, size: int) -> int:
        room = self._least(size)
        if room < 0:
            found, room = self.made, self.capacity
            self.made += 1
        else:
            found = self.bins[room].pop()
            self._add(room, -1)
        if room > size:
            self.bins[room - size].append(found)
            self._add(room - size, 1)
        return found


def _pieces(lengths: list[int], size: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full sequences and the other pieces, as (piece, start, length); longest first."""
    full = [[(d, 0, n)] for d, n in enumerate(lengths) if n == size]
    return full, sorted(((d, 0, n) for d, n in enumerate(lengths) if 0 < n < size), key=lambda x: (-x[2], x[0]))


def fill(bins: list[list[tuple[int, int, int]]], size: int) -> list[list[tuple[int, int, int]]]:
    """Close the gaps: the emptiest bins' pieces are cut and dealt into the room left in the others, and what
    remains of the last one becomes sequences with a power of two of tokens, which need no padding.
    """
    used = [sum(x[2] for x in b) for b in bins]
    exact = lambda n: n == size or n & (n - 1) == 0
    done = [b for b, n in zip(bins, used, strict=True) if exact(n)]
    left = [(n, b) for n, b in sorted(zip(used, bins, strict=True), key=lambda x: -x[0]) if not exact(n)]
    while len(left) > 1:
        n, b = left.pop(0)
        while n < size and left:
            m, donor = left[-1]
            d, start, length = donor.pop()
            cut = min(length, size - n)
            b.append((d, start + length - cut, cut))
            if cut < length:
                donor.append((d, start, length - cut))
            n += cut
            left[-1] = (m - cut, donor)
            if m == cut:
                left.pop()
        if exact(n):
            done.append(b)
        else:
            left.append((n, b))
    for n, b in left:
        while n:
            want = min(size, 1 << (n.bit_length() - 1))
            n -= want
            done.append(part := [])
            while want:
                d, start, length = b.pop()
                cut = min(length, want)
                part.append((d, start + length - cut, cut))
                if cut < length:
                    b.append((d, start, length - cut))
                want -= cut
    return done


def first_fit_decreasing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = 1024, docs_per_group: int = 2048, end_id: int = 0, close_gaps: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset. With ``close_gaps`` documents that first-fit
    kept whole may be cut in the end, to fill the gaps that it leaves (:func:`fill`).

    Each document's ids end with ``end_id``, so that null and empty texts make one piece of one id. Documents
    above ``size``, however long, are cut into full sequences and a rest; rests are packed by first-fit decreasing, equally long ones in
    any order. Repeated rows are packed as often as they occur, null ids are kept; other columns aren't carried, whatever their names.
    An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    rows, dtype = _grouped(df, id_col, text_col, path, size, docs_per_group, end_id), id_type(path)

    def pack(table: pa.Table) -> pa.Table:
        give_back()
        ids = [np.frombuffer(x.as_buffer(), dtype).astype("<u4") for x in table.column("ids")]
        lengths = [len(x) for x in ids]
        bins, rest = _pieces(lengths, size)
        tree = Tournament(len(rest), size)
        opened: dict[int, list[tuple[int, int, int]]] = {}
        for x in rest:
            opened.setdefault(tree.take(x[2]), []).append(x)
        bins += opened.values()
        if close_gaps:
            bins = fill(bins, size)
        base = table.column("g")[0].as_py() << 32
        begins, totals = table.column("start").to_pylist(), table.column("total").to_pylist()
        at, start, length, crc, seq, offset = [], [], [], [], [], []
        for k, b in enumerate(bins):
            o = 0
            for d, s, n in b:
                at.append(d)
                start.append(begins[d] + s)
                length.append(n)
                crc.append(zlib.crc32(ids[d][s : s + n]))
                seq.append(base + k)
                offset.append(o)
                o += n
        long = lambda x: pa.array(x, pa.int64())
        return pa.table([table.column("id").take(pa.array(at, pa.int64())), long(start), long(length), long(crc), long([totals[d] for d in at]), long(seq), long(offset)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(rows.dtypes)["id"]
    return rows.groupBy("g").applyInArrow(pack, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def best_fit_decreasing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = 2048, docs_per_group: int = 2048, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """One row per sequence, ready to be written: ``sequence_id``, ``n_tokens``, ``input_ids`` (binary,
    ``size`` little-endian ids of 2 bytes, or 4 for over 65,536 ids; padded with ``pad_id``), ``cu_seqlens``
    (cumulative segment lengths from 0), ``position_resets`` (where positions start again from 0),
    ``doc_ids`` and ``doc_starts`` (each segment's document and its place in that document's ids).

    Documents above ``size``, however long, are cut into full sequences and a rest, so that the segments of a document
    in order of ``doc_starts`` are exactly its ids. Null texts count as empty and make a segment of one ``end_id``. Repeated rows are packed as often
    as they occur, null ids are kept, equally long rests come in any order; other columns aren't carried, whatever their names. An empty table
    gives no rows.
    """
    path = tokenizer or default_tokenizer()
    rows, dtype = _grouped(df, id_col, text_col, path, size, docs_per_group, end_id), id_type(path)

    def pack(table: pa.Table) -> pa.Table:
        give_back()
        ids = [np.frombuffer(x.as_buffer(), dtype) for x in table.column("ids")]
        bins, rest = _pieces([len(x) for x in ids], size)
        tree, opened = Capacities(size), {}
        for x in rest:
            opened.setdefault(tree.take(x[2]), []).append(x)
        bins += opened.values()
        base, names, begins = table.column("g")[0].as_py() << 32, table.column("id"), table.column("start").to_pylist()
        matrix = np.full((len(bins), size), pad_id, dtype)
        ends, resets, docs, starts = [], [], [], []
        for k, b in enumerate(bins):
            cu = [0]
            for d, s, n in b:
                matrix[k, cu[-1] : cu[-1] + n] = ids[d][s : s + n]
                cu.append(cu[-1] + n)
            ends.append(cu)
            resets.append(cu[:-1])
            docs.append([names[d].as_py() for d, _, _ in b])
            starts.append([begins[d] + s for d, s, _ in b])
        return pa.table(
            [pa.array([base + k for k in range(len(bins))], pa.int64()), pa.array([x[-1] for x in ends], pa.int32()), pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(docs, pa.list_(names.type)), pa.array(starts, pa.list_(pa.int64()))],
            names=["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
        )

    kind = dict(rows.dtypes)["id"]
    return rows.groupBy("g").applyInArrow(pack, f"sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, doc_starts array<long>")
