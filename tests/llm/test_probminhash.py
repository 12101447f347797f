import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import probminhash as pmh
from rollcall.llm.queries import op10_probminhash_near_dedup

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def sets_of(text):
    words = WORD.findall((text or "").lower())
    if not words:
        return None
    return words, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Class of each row by comparing all pairs that share a shingle."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    same = {}
    for i, s in enumerate(sets):
        if s is None:
            if rows[i][1]:
                parent[find(i)] = find(same.setdefault(rows[i][1], i))
            continue
        parent[find(i)] = find(same.setdefault(tuple(s[0]), i))
        for x in s[1]:
            holders[x].append(i)
    pairs = defaultdict(int)
    for members in holders.values():
        for k, i in enumerate(members):
            for j in members[k + 1 :]:
                pairs[i, j] += 1
    for (i, j), both in pairs.items():
        if both * 10 >= 8 * (len(sets[i][1]) + len(sets[j][1]) - both):
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sorted(sorted(g) for g in groups.values())


def classes(got):
    groups = defaultdict(list)
    for i, c in got:
        groups[c].append(i)
    return sorted(sorted(g) for g in groups.values())


def test_shingles():
    who, value, count, names, twins = pmh.shingles(pa.array(["A b, c-d e f", "", "one Two", "...", "a b c d e a b c d e a b c d e", "one  two!", "two one"]))
    assert np.bincount(who, minlength=7).tolist() == [2, 0, 1, 0, 5, 1, 1]
    assert count[who == 4].tolist().count(3) == 1 and count[who == 4].sum() == 11
    assert names[1] == 0 and names[3] != 0 and names[2] == names[5] != names[6]
    assert twins[1] == 0 and twins[3] != 0 and twins[2] == twins[5] != twins[6] and not set(names[[0, 2, 3, 4, 6]].tolist()) & set(twins.tolist())
    assert value[who == 2].tolist() == value[who == 5].tolist() != value[who == 6].tolist()


def test_ideographs_are_words():
    who, _, count, names, _ = pmh.shingles(pa.array(["我们今天去公园玩。", "ab我 们cd", "ab 我们 cd", "ab 我 们 cd", "ありがとう ございます"]))
    assert np.bincount(who, count, 5).tolist() == [5, 1, 1, 1, 6] and names[1] == names[2] == names[3]


def test_estimate_of_weighted_similarity():
    rng = np.random.default_rng(3)
    n, m = 300, 6000
    a, b = np.exp(rng.normal(size=n)), np.exp(rng.normal(size=n)) * 5
    b[: n // 4] = 0
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(n) if b[i])
    value = rng.integers(1, 1 << 62, n).astype(np.uint64)
    who = np.concatenate([np.zeros(n, int), np.ones((b > 0).sum(), int)])
    sig = pmh.signature(who, np.concatenate([value, value[b > 0]]), np.concatenate([a, b[b > 0]]), 2, m)
    assert (sig != 0).all() and abs((sig[0] == sig[1]).mean() - want) < 0.03


def varied(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[i] = f"new{rng.randint(0, 10**9)}"
    return out


@pytest.mark.parametrize("pairs_below", [2, 16])
def test_classes_equal_all_pairs(spark, pairs_below):
    rng = random.Random(9)
    rows, base = [], [[f"w{rng.randint(0, 5000)}" for _ in range(150)] for _ in range(12)]
    for k, b in enumerate(base):
        for _ in range((40, 3, 2, 1)[k % 4]):
            rows.append(" ".join(varied(rng, b, rng.choice([0.005, 0.01, 0.02, 0.04]))))
        rows += [" ".join(b)] * (30 if k == 0 else 1)
    shared = [f"s{i}" for i in range(60)]
    for _ in range(40):  # a passage that many texts share makes no class
        rows.append(" ".join(shared + [f"q{rng.randint(0, 10**9)}" for _ in range(30)]))
    # A chain: neighbours are alike, the ends aren't.
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):
        rows.append(" ".join(chain[: 200 - 8 * i] + [f"d{j}" for j in range(8 * i)]))
    rows += [None, "", "", "  ", "  ", "one two", "One, two", "one two three", "!!", "!!", "?"]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(7)
    got = pmh.near_duplicates(df, pairs_below=pairs_below, part=7).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert classes((r.doc_id, r.class_id) for r in got) == want
    size = {i: len(g) for g in want for i in g}
    assert all(r.class_size == size[r.doc_id] for r in got)
    kept = pmh.deduplicated(df, pairs_below=pairs_below)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in want)


def test_ids_missing_or_repeated(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (None, text), (None, "other words " * 9), (4, text + " eight nine"), (4, text + " eight nine"), (4, "quite another text"), (9, None)], "doc_id long, text string")
    got = pmh.near_duplicates(df).collect()
    assert len(got) == 7
    kept = pmh.deduplicated(df).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept) == [(0, "one t"), (0, "other"), (4, "one t"), (4, "quite"), (9, "")]
    assert pmh.near_duplicates(df.limit(0)).count() == 0 and pmh.deduplicated(df.limit(0)).count() == 0


def test_lines_repeated_in_one_text_only(spark):
    """The verified similarity of sets doesn't depend on how often a line is repeated, so the search mustn't either."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        own, line = ([f"p{k}x{rng.randint(0, 10**9)}" for _ in range(n)] for n in ((20, 15), (40, 15), (80, 30))[k % 3])
        rows += [" ".join(own + line), " ".join(own + line * (10, 40)[k % 2])]
    rows = list(enumerate(rows))
    want = brute(rows)
    assert len(want) == 60
    got = pmh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert classes((r.doc_id, r.class_id) for r in got) == want


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op10_probminhash_near_dedup(spark, sf).collect()
    want = [[docs[i][0] for i in g] for g in brute(docs)]
    assert classes((r.doc_id, r.class_id) for r in got) == sorted(sorted(g) for g in want)


def test_result_has_classes_only(spark):
    """Links within large buckets are found only as far as classes need them, so that their number would depend on the bucket's size."""
    assert op10_probminhash_near_dedup(spark, "/root/testdata/sf0.001").columns == ["doc_id", "class_id", "class_size"]
