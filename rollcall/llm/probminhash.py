"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification.

Shingles are five lower-cased words (runs of letters and digits; each ideograph or kana is a word); a text of one to four words is one shingle. A shingle
that occurs ``n`` times weighs ``1 + ln(n)``. Each shingle sends arrivals of a Poisson process of that rate to random
registers; a register keeps its first arrival, and a shingle stops when its next arrival comes later than all
registers' first ones. Two texts share a register with the chance of their probability Jaccard similarity.
A second signature gives all shingles the weight 1, so that the chance is the Jaccard similarity of the sets, which is verified.

Texts that agree in a band of registers of either signature are candidates; those whose sets of shingles have a Jaccard similarity of at least ``threshold``
are linked. Classes are the connected texts. Texts are told apart by 128 bits of hash of their words (without words: of the
text), so that copies are one node. Null and empty texts are in no class but their own.

Up to ``pairs_below`` texts in a bucket are compared with each other; larger buckets compare their texts with a few centres, round by round, until every
text outside the bucket's main class has been a centre. That finds every class that all pairs would, and costs few comparisons where a bucket holds mostly one class. A bucket
of texts that are alike enough to meet but not to be linked costs as many comparisons as all its pairs, spread over tasks: its texts are dealt into parts
of about ``part``, each with all centres. No rows are made of pairs that aren't links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_slices, utf8_parts

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(col: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted and distinct, and each text's two hashes (0 for empty texts)."""
    raw, off = utf8_parts(pc.utf8_lower(col))
    n = len(col)
    names, twins = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none.astype(np.uint64), none, names, twins
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    place = (np.arange(len(raw)) - np.repeat(off[:-1], size)).astype(np.uint64)
    solid = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 0x80)
    has = np.bincount(doc, solid, n) > 0
    # Texts without words are named by all their bytes.
    odd = np.flatnonzero(~has & (size > 0))
    for i in odd.tolist():
        part = slice(int(off[i]), int(off[i + 1]))
        bytes_ = mix((raw[part].astype(np.uint64) + np.uint64(1)) * K1 + place[part] * K2)
        names[i], twins[i] = mix(np.array([bytes_.sum(), mix(bytes_ + K1).sum()], np.uint64) + np.array([K3, K2]))
    at = np.flatnonzero(solid)
    if not len(at):
        return none, none.astype(np.uint64), none, names, twins
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    # Characters from U+3000 to U+9FFF (three bytes, the first one from E3 to E9) are words of their own.
    alone = np.flatnonzero((raw[at] >= 0xE3) & (raw[at] <= 0xE9))
    first[alone] = True
    first[alone[alone + 3 < len(at)] + 3] = True
    begin = np.flatnonzero(first)
    inner = at - np.repeat(at[begin], np.diff(np.append(begin, len(at))))
    letters = mix((raw[at].astype(np.uint64) + np.uint64(1)) * K1 + inner.astype(np.uint64) * K2)
    word = mix(np.add.reduceat(letters, begin))
    twin = mix(np.add.reduceat((letters ^ (letters >> np.uint64(29))) * K2, begin))
    own = doc[at[begin]]
    count = np.bincount(own, minlength=n)
    starts = np.cumsum(count) - count
    index = (np.arange(len(word)) - starts[own]).astype(np.uint64)
    total = np.zeros(n, np.uint64)
    some = np.flatnonzero(count)
    total[some] = np.add.reduceat(mix(word + index * K3), starts[some])
    names[some] = np.maximum(mix(total[some] + count[some].astype(np.uint64)), np.uint64(1))
    total[some] = np.add.reduceat(mix(twin * K1 + index * K2), starts[some])
    twins[some] = mix(total[some] + count[some].astype(np.uint64))
    # A shingle at each word that has four more behind it in its text, or at the first word of a short text.
    whole = np.minimum(count, words)
    heads = np.flatnonzero((index.astype(np.int64) + whole[own]) <= count[own])
    heads = heads[(count[own[heads]] >= words) | (index[heads] == 0)]
    value = np.zeros(len(heads), np.uint64)
    for j in range(words):
        inside = j < whole[own[heads]]
        value[inside] = mix(value[inside] * K1 + word[heads[inside] + j] + np.uint64(j))
    who = own[heads]
    order = np.lexsort((value, who))
    who, value = who[order], value[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return who[at], value[at], np.diff(np.append(at, len(who))), names, twins


def signature(who: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the shingle that arrived first at each register (0: none)."""
    first = np.full((texts, registers), np.inf)
    owner = np.zeros((texts, registers), np.uint64)
    flat, names = first.ravel(), owner.ravel()
    live = np.arange(len(who))
    time = np.zeros(len(who))
    latest = np.full(texts, np.inf)
    turn = 0
    while len(live):
        turn += 1
        h = mix(value[live] + np.full(1, turn, np.uint64) * K1)
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight[live]
        time[live] += gap
        t = time[live]
        early = t < latest[who[live]]
        live, t, h = live[early], t[early], h[early]
        slot = who[live] * registers + (mix(h + K2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, slot, t)
        won = flat[slot] == t
        names[slot[won]] = value[live[won]]
        docs = np.unique(who[live])
        latest[docs] = first[docs].max(1)
        live = live[t < latest[who[live]]]
    return owner


def signatures(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``h1`` and ``h2`` (hashes of its words), ``n`` (distinct shingles) and ``keys`` (one per band of the unit and of the weighted signature, equal ones once) of every row."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))

    def keys_of(who: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        sig = signature(who, value, weight, texts, bands * rows).reshape(texts, bands, rows)
        key = np.broadcast_to((np.arange(bands, dtype=np.uint64) + np.uint64(1)) * K3, sig.shape[:2]).copy()
        for j in range(rows):
            key = mix(key * K1 + sig[:, :, j])
        return key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_slices(batches, "text", 2 << 20):
            who, value, count, names, twins = shingles(col)
            n = np.bincount(who, minlength=len(col))
            key = np.zeros((len(col), 2, bands), np.uint64)
            key[:, 0] = keys_of(who, value, np.ones(len(who)), len(col))
            own = np.zeros(key.shape, bool)
            own[:, 0] = (n > 0)[:, None]
            # Where no shingle is repeated, both signatures are the same.
            again, k = np.unique(who[count > 1]), np.zeros(len(col), np.int64)
            k[again] = np.arange(len(again))
            part = np.isin(who, again)
            key[again, 1] = keys_of(k[who[part]], value[part], 1 + np.log(count[part]), len(again))
            own[again, 1] = key[again, 1] != key[again, 0]
            offsets = np.concatenate([[0], np.cumsum(own.sum((1, 2)))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[own].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(names.view(np.int64)), pa.array(twins.view(np.int64)), pa.array(n.astype(np.int32)), keys], names=["id", "th", "h1", "h2", "n", "keys"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, th long, h1 long, h2 long, n int, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node`` and its shingles ``s``, from rows of ``node`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_slices(batches, "text", 2 << 20):
            who, value, *_ = shingles(col)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(col)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))], names=["node", "s"])

    return docs.select("node", "text").mapInArrow(run, "node long, s array<long>")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the least node it is connected with) of all nodes of ``links`` (a, b)."""
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    comp = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = edges.join(comp.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = comp.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = saved(step.join(jump, "comp").select("node", "old", F.least("comp", "far").alias("comp")))
        comp = new.select("node", "comp")
        if new.filter("comp <> old").isEmpty():
            return comp


def similar(x: str, y: str, threshold: float):
    """Whether two sets have a Jaccard similarity of at least the threshold (less what doubles lose of it)."""
    both = F.size(F.array_intersect(x, y))
    return both >= F.lit(threshold - 1e-12) * (F.size(x) + F.size(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").filter(similar("sa", "sb", threshold)).select("a", "b")


def _by_centres(big: DataFrame, comp: DataFrame, sets: DataFrame, threshold: float, part: int) -> DataFrame | None:
    """Further links (a, b) between classes, of buckets with many texts (key, node, n, c, least); None if there are none. Every text has been compared with its
    bucket's ``least`` one. Each round merges classes as it goes on, and only buckets with open texts stay.
    """
    first = big.join(comp, "node", "left").select("key", "node", "n", "c", F.coalesce("comp", "node").alias("comp"), (F.col("node") == F.col("least")).alias("used"))
    state, found, turn = saved(first), None, 0
    while True:
        groups = state.groupBy("key", "comp").agg(F.count("*").alias("k"), F.count_if(~F.col("used")).alias("u"))
        main = F.max_by(F.struct("comp", "u"), F.struct("k", "comp")).alias("main")
        stat = groups.groupBy("key").agg(main, F.sum("u").alias("u")).select("key", F.col("main.comp").alias("main"), (F.col("u") - F.col("main.u")).alias("left"))
        stat = saved(stat.filter("left > 0"))
        if stat.isEmpty():
            return found
        share = F.greatest(F.lit(1), F.floor(F.col("left") / F.lit(4 * 8**turn)))
        pick = (F.col("comp") != F.col("main")) & ~F.col("used") & (F.pmod(F.xxhash64("node", F.lit(turn)), share) == 0)
        parts = F.ceil(F.col("c") / F.lit(part)).cast("int")
        state = saved(state.join(stat, "key").select("key", "node", "n", "c", "comp", "used", pick.alias("pick"), parts.alias("parts")))
        # Compared within the join, so that it makes rows of true links only.
        here = state.join(sets, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        centre = state.filter("pick").select("key", F.col("node").alias("centre"), F.col("n").alias("nc"), F.col("comp").alias("cc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        there = centre.join(sets.select(F.col("node").alias("centre"), F.col("s").alias("sc")), "centre")
        alike = (F.col("comp") != F.col("cc")) & fits("n", "nc", threshold) & similar("s", "sc", threshold)
        both = here.join(there, (here["key"] == there["key"]) & (here["part"] == there["part"]) & alike)
        new = saved(both.select(F.least("comp", "cc").alias("a"), F.greatest("comp", "cc").alias("b")).distinct())
        state = state.select("key", "node", "n", "c", "comp", (F.col("used") | F.col("pick")).alias("used"))
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            merged = components(new).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
            state = state.join(merged, "comp", "left").select("key", "node", "n", "c", F.coalesce("into", "comp").alias("comp"), "used")
        state, turn = saved(state), turn + 1


def fits(x: str, y: str, threshold: float):
    """Sets whose sizes differ more can't be similar enough."""
    return F.least(x, y) >= F.lit(threshold - 1e-12) * F.greatest(x, y)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 32, rows: int = 6, pairs_below: int = 16, part: int = 256) -> DataFrame:
    """``id_col``, ``class_id`` (the least id of the class), ``class_size`` (rows), ``th`` (hash of the text) and ``class_key``; one row per row.

    With the default bands a pair whose sets have a similarity of 0.8 is missed with a chance of at most 0.00006, however often
    their shingles are repeated, as the unit signature alone finds it with that chance. Repeated rows and copies share a class.
    Rows with null ids are kept; a class of such rows only has a null id. Other columns aren't carried, whatever their names. Very long
    texts are read as a whole. An empty table gives no rows.
    """
    sig = saved(signatures(df, id_col, text_col, bands, rows))
    # One row per node, with a number that nothing else has: nodes' least id tells a row whose text stands for all copies.
    least = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "th", "n", "keys")).alias("r")
    nodes = sig.filter("h1 <> 0").groupBy("h1", "h2").agg(least, F.count("*").alias("rows"))
    nodes = saved(nodes.select("h1", "h2", (F.monotonically_increasing_id() + 1).alias("node"), "rows", "r.id", "r.th", "r.n", "r.keys"))
    band = nodes.select("node", "n", F.explode("keys").alias("key"))
    # Written, so that both sides of the join are plain and a hot key is split.
    size = saved(band.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("least")).filter("c > 1"))
    members = saved(band.join(size, "key").select("key", "node", "n", "c", "least"))

    few = members.filter(F.col("c") <= pairs_below).select("key", "node", "n")
    pairs = few.select("key", F.col("node").alias("a"), F.col("n").alias("na")).join(few.select("key", F.col("node").alias("b"), F.col("n").alias("nb")), "key").filter((F.col("a") < F.col("b")) & fits("na", "nb", threshold)).select("a", "b")
    many = members.filter(F.col("c") > pairs_below)
    size_of = nodes.select(F.col("node").alias("least"), F.col("n").alias("nl"))
    star = many.filter("node <> least").select("least", "node", "n").distinct().join(size_of, "least").filter(fits("n", "nl", threshold)).select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = saved(pairs.unionByName(star).distinct())

    # Shingles of all texts that may still be compared.
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(many.select("node")).distinct()
    wanted = nodes.select("node", F.col("id").alias("want"), F.col("th").alias("wth")).join(wanted, "node", "left_semi")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    texts = docs.join(wanted, (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("want")))
    sets = saved(shingle_sets(texts).dropDuplicates(["node"]))

    links = saved(_verified(pairs, sets, threshold))
    comp = components(links)
    more = None if many.isEmpty() else _by_centres(many, comp, sets, threshold, part)
    if more is not None:
        comp = components(links.unionByName(more))

    ids = nodes.join(comp, "node", "left").select("h1", "h2", "id", "rows", F.coalesce("comp", "node").alias("comp"))
    classes = saved(ids.groupBy("comp").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_size")))
    named = saved(ids.select("h1", "h2", "comp").join(classes, "comp").select("h1", "h2", "class_id", "class_size", F.col("comp").alias("class_key")))
    empty = sig.filter("h1 = 0").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "th", F.lit(0).cast("long").alias("class_key"))
    return sig.filter("h1 <> 0").select("id", "th", "h1", "h2").join(named, ["h1", "h2"]).select(F.col("id").alias(id_col), "class_id", "class_size", "th", "class_key").unionByName(empty)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one row of each class: the one with the least id. Null and empty texts are all kept."""
    found = near_duplicates(df, id_col, text_col, **options)
    least = F.min(F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("__keep"), F.col("th").alias("__kth")))
    keep = found.filter("class_key <> 0").groupBy("class_key").agg(least.alias("r")).select("r.__keep", "r.__kth")
    hashed = df.withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    blank = hashed.filter(F.coalesce(F.col(text_col), F.lit("")) == "").drop("__th")
    full = hashed.filter(F.col(text_col) != "")
    kept = full.join(keep, (F.col("__th") == F.col("__kth")) & F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi").dropDuplicates([id_col, "__th"])
    return kept.select(df.columns).unionByName(blank.select(df.columns))
