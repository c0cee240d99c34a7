"""Packing and mixing: everything placed once, capacities kept, apportionment as by hand."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm.mixing import mix, mix_shares, sainte_lague
from glyphmill.llm.packing import full_patterns, nnls, pack, pack_fill, pack_histogram
from glyphmill.llm.tokenizer import PIECE_CHARS, TOKENIZER_DIR, TOKENIZER_FILE, count_tokens, token_count


@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
@settings(max_examples=150, deadline=None)
def test_histogram_is_used_up_within_capacity(lengths, capacity):
    h = Counter(lengths)
    plan = pack_histogram(np.array(sorted(h)), np.array([h[k] for k in sorted(h)]), capacity, 16)
    used = Counter()
    for times, content in plan:
        assert times > 0 and sum(n * m for n, m in content.items()) <= capacity
        used.update({n: m * times for n, m in content.items()})
    assert used == h


def test_packs_are_nearly_full():
    rng = np.random.default_rng(1)
    lengths = np.minimum(512, rng.lognormal(4.5, 1.0, 50_000).astype(int) + 1)
    n, c = np.unique(lengths, return_counts=True)
    plan = pack_histogram(n, c, 512)
    assert lengths.sum() / (512 * sum(t for t, _ in plan)) > 0.98


def test_nnls_finds_a_non_negative_optimum():
    rng = np.random.default_rng(2)
    a, x = rng.random((12, 20)), np.maximum(0, rng.normal(size=20))
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-6
    b = rng.normal(size=12)
    got = nnls(a, b)
    gain = a.T @ (b - a @ got)
    assert (gain < 1e-6).all() and np.abs(gain[got > 0]).max(initial=0) < 1e-6


def test_patterns_fill_exactly():
    p = full_patterns(12)
    assert len(p) == len(set(p)) and all(sum(x) == 12 for x in p) and (2, 3, 7) in p


def test_pack_places_every_item_once(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 5, 5, 5, 30, 63, 64, 65, 200, rng.randint(1, 64)])) for k in range(600)] + [(1000, None), (1001, 0), (1002, 64 * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").withColumn("piece", F.lit("clash")).withColumn("capacity", F.lit("clash"))
    packed = pack(df, {"s": 64, "l": 256}, units=16, part_items=40)
    got = packed.collect()
    for name, cap in (("s", 64), ("l", 256)):
        mine = [r for r in got if r.pack_name == name]
        fill = Counter()
        for r in mine:
            fill[r.pack_id] += r.tokens
        assert max(fill.values()) <= cap and all(r.pack_tokens == fill[r.pack_id] and r.capacity == cap for r in mine)
        whole = Counter()
        for r in mine:
            whole[r.doc_id] += r.tokens
        assert whole == Counter({k: n for k, n in rows if n})
        pieces = Counter(r.doc_id for r in mine)
        assert all(pieces[k] == -(-n // cap) for k, n in rows if n)
    assert {(r.pack_name, r.packs) for r in pack_fill(packed).collect()} == {(n, len({r.pack_id for r in got if r.pack_name == n})) for n in ("s", "l")}


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), {"s": 8}).count() == 0


def _by_hand(weights, seats, caps):
    out, heap = [0] * len(weights), [(-w, k) for k, w in enumerate(weights) if w > 0 and caps[k] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        seats -= 1
        if out[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return out


@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 30)), min_size=1, max_size=12), st.integers(0, 80))
@settings(max_examples=300, deadline=None)
def test_sainte_lague_by_highest_quotients(rows, seats):
    w, caps = np.array([float(x) for x, _ in rows]), np.array([c for _, c in rows])
    got, want = sainte_lague(w, seats, caps), _by_hand(w.tolist(), seats, caps.tolist())
    assert got.sum() == sum(want)
    # equal quotients may fall to other entries; the quotients given are the same
    q = lambda s: sorted(w[k] / (2 * j + 1) for k in range(len(w)) for j in range(s[k]))
    assert np.allclose(q(got), q(want))


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    rows = [(k, " Big " if k % 3 == 0 else "small" if k % 10 == 1 else "mid", rng.randint(1, 60)) for k in range(6000)] + [(9000, None, 5), (9001, "big", None), (9002, "other", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("shard", F.lit("clash"))
    t = spark.createDataFrame([("m", "big", 0.2, 1), ("m", "small", 0.5, 3), ("m", "mid", 0.3, 1), ("n", "gone", 0.5, 2), ("n", "mid", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    drawn = mix(df, t)
    got = drawn.collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows[:6000]} and len({(r.mix_name, r.doc_id) for r in got}) == len(got)
    assert max(r.copies for r in got if r.mix_name == "m" and r.source == "small") == 3 and max(r.copies for r in got if r.source == "big") == 1
    s = {(r.mix_name, r.source): r for r in mix_shares(drawn, t).collect()}
    for source, want in (("big", 0.2), ("small", 0.5), ("mid", 0.3)):
        assert s["m", source].actual_share == pytest.approx(want, abs=0.002)
    assert s["n", "gone"].tokens == 0 and s["n", "mid"].actual_share == 1.0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df, t).collect()))
    many = mix(df, t, shard_tokens=2_000, group_shards=4)  # shards in groups
    s = {(r.mix_name, r.source): r for r in mix_shares(many, t).collect()}
    for source, want in (("big", 0.2), ("small", 0.5), ("mid", 0.3)):
        assert s["m", source].actual_share == pytest.approx(want, abs=0.01)


def test_no_text_is_drawn_more_often_than_its_repeats(spark):
    rows = [(k, "a" if k % 2 else "b", 10, "copied" if k < 400 else f"t{k}") for k in range(1000)] + [(2000, "a", 10, None), (2001, "b", 10, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, text_key string")
    t = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2), ("n", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got, key = mix(df, t).collect(), {r[0]: r[3] or r[0] for r in rows}
    taken = Counter()
    for r in got:
        taken[r.mix_name, key[r.doc_id]] += r.copies
    assert max(taken.values()) == 2 and taken["m", "copied"] <= 2 and len(taken) > 900 and {n for (m, _), n in taken.items() if m == "n"} == {1}


def test_mix_of_nothing(spark):
    t = spark.createDataFrame([("m", "a", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    assert mix(spark.createDataFrame([], "doc_id bigint, source string, tokens bigint"), t).count() == 0


def test_token_counts(spark):
    path = f"{TOKENIZER_DIR}/{TOKENIZER_FILE}"
    text = "The quick brown fox, naïve 漢字. " * 3
    import tiktoken  # noqa: F401

    from glyphmill.llm.tokenizer import _encoder

    long = "word  and\n more ,, text " * (PIECE_CHARS // 8)
    assert count_tokens(long, path) == len(_encoder(path).encode_ordinary(long))
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    assert [r.n for r in df.select(token_count(F.col("text")).alias("n")).collect()] == [len(_encoder(path).encode_ordinary(text)), None, 0]
