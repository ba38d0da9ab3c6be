import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from millrace.llm.bpe import BYTE_BPE_50K, PATTERN, TOKENIZER_DIR, Encoder, encode_texts, merge_piece, read_ranks
from millrace.llm.packing import best_fit, pack

RANKS = read_ranks(os.path.join(TOKENIZER_DIR, BYTE_BPE_50K))
ENCODER = Encoder(RANKS)


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_agrees_with_the_public_encoder(public, text):
    assert ENCODER.encode(text) == public.encode_ordinary(text)
    assert ENCODER.count(text) == len(ENCODER.encode(text))


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh", " ", "中文字符", "é🙂x", "01"])
def test_long_pieces(public, alphabet):
    rng = random.Random(3)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    assert ENCODER.encode(text) == public.encode_ordinary(text)


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=24), st.lists(st.binary(min_size=2, max_size=4), max_size=12))
def test_merges_like_repeated_search(piece, extra):
    ranks = {bytes([b]): b for b in range(256)}
    for m in extra:
        ranks.setdefault(m, len(ranks))
    for m in [piece[i : i + 2] for i in range(0, max(0, len(piece) - 1), 3)]:
        ranks.setdefault(m, len(ranks))
    assert merge_piece(piece, ranks) == plain_merge(piece, ranks)


def test_encode_operator(spark, rows):
    df = spark.createDataFrame([(1, "<|endoftext|>", 0), (2, None, 0), (3, "", 0), (None, "hi", 0), (5, "x " * 50_000, 0), (6, "hi", 0), (6, "hi", 0)], "doc_id bigint, text string, ids int")
    got = rows(encode_texts(df, "doc_id", "text"))
    assert len(got) == 7
    by = {k: v for k, v in got}
    assert 50256 not in by[1] and len(by[1]) == 7
    assert by[2] == by[3] == [] and by[None] == by[6] and len(by[5]) > 50_000
    assert rows(encode_texts(df.limit(0), "doc_id", "text")) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = best_fit([(s, [i]) for i, s in enumerate(sorted(sizes, reverse=True))], 50)
    assert sorted(i for _, m in bins for i in m) == list(range(len(sizes)))
    assert all(f <= 50 for f, _ in bins)
    assert sum(a[0] + b[0] <= 50 for n, a in enumerate(bins) for b in bins[:n]) <= 0 or len(bins) < 2  # no two fit together


def test_pack(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 7, 60, 99, 100, 101, 250, 1000])) for i in range(3000)] + [(None, 5), (7, 12), (7, 12), (9000, None), (9001, -3)]
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes], "doc_id bigint, n bigint, container string").repartition(9)
    out = pack(df, "doc_id", "n", capacity=100).collect()
    filled, total = {}, {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert (r["container"] is None) == (r["n_tokens"] == 0)
        if r["container"]:
            filled[r["container"]] = filled.get(r["container"], 0) + r["n_tokens"]
    want = {}
    for k, n in sizes:
        want[k] = want.get(k, 0) + max(0, n or 0)
    assert total == want
    assert max(filled.values()) <= 100
    parts = sorted((r["part"], r["start_at"], r["n_tokens"]) for r in out if r["doc_id"] == next(k for k, n in sizes if n == 250 and k != 7))
    assert parts == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    pieces = [p for _, n in sizes for p in [100] * (max(0, n or 0) // 100) + [max(0, n or 0) % 100] if p]
    assert len(filled) <= 1.005 * len(best_fit([(p, [0]) for p in sorted(pieces, reverse=True)], 100)) + 1  # as one partition would
    assert pack(df.limit(0), "doc_id", "n").count() == 0


def test_many_open_containers_meet_from_other_partitions(spark):
    """25,000 items of 60 and 25,000 of 40 in other partitions, packed 2,000 at a time."""
    items = spark.range(0, 50_000, numPartitions=10).selectExpr("id AS doc_id", "IF(id < 25000, 60, 40) AS n")
    fills = pack(items, "doc_id", "n", capacity=100, together=2000).groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("n"))
    n, most, items_in = fills.agg(F.count("*"), F.max("fill"), F.sum("n")).first()
    assert (most, items_in) == (100, 50_000) and n <= 25_000 * 1.02, n


def test_containers_that_fit_nothing_end_at_once(spark):
    items = spark.range(0, 5000, numPartitions=5).selectExpr("id AS doc_id", "60 AS n")
    assert pack(items, "doc_id", "n", capacity=100, together=100).select("container").distinct().count() == 5000
