import hashlib
import random

import pyarrow as pa
import pytest

from rollcall.llm import bpe
from rollcall.llm.queries import op4_tree_bpe

PARTS = ["a", "the", "'s", "'t", " ", "  ", "\n", "é", "ß", "!", "!!", "1", "22", "<|endoftext|>", "<|endo", "😀", "語", " ", "\t", "ll", "'ll", "\xa0", "x" * 9, "aaaa", "́"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.default_tokenizer())


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_library(enc, seed):
    rng = random.Random(seed)
    for _ in range(300):
        some = rng.sample(PARTS, rng.choice([2, 3, 5, 12]))
        text = "".join(rng.choice(some) for _ in range(rng.choice([3, 20, 80, 300])))
        want = enc.tok.encode(text, add_special_tokens=False).ids
        (got,) = enc.many_by_tree(pa.array([text]), rng.choice([3, 8, 16, 50]))
        assert got.tolist() == want, text
        flat, at = enc.many(pa.array([text, "", text]))
        assert flat.tolist() == want * 2 and at.tolist() == [0, len(want), len(want), 2 * len(want)]


def test_without_ranks(enc, monkeypatch):
    text = "".join(f" wor{i}d" for i in range(300)) + " end  "
    want = enc.one(text).tolist()
    other = bpe.Encoder(bpe.default_tokenizer())
    other.ranked = None
    assert other.many(pa.array([text]))[0].tolist() == want


def test_long_unsplit_run(enc):
    text = "abcdefghij" * 3000
    (got,) = enc.many_by_tree(pa.array([text]), 512)
    assert got.tolist() == enc.one(text).tolist()


def test_rows_chunks_nulls_copies(spark, enc):
    long = " ".join(f"word{i % 977}ing" for i in range(2000)) + "y" * 700
    rows = [(1, "x", None), (2, "x", ""), (3, "x", long), (3, "x", long), (3, "x", long + "!"), (None, "x", "no id"), (4, "x", "one two")]
    df = spark.createDataFrame(rows, "doc_id long, ids string, text string")
    got = bpe.digests(bpe.encode(df, chunk_chars=500, leaf_bytes=64)).collect()
    want = []
    for i, _, t in rows:
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.encode(df.limit(0)).count() == 0


def test_query(spark, sf_dir, enc):
    got = {r[0]: r for r in op4_tree_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.tok.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(enc.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
