"""Shared spans against a comparison of all runs, on texts with copies, shifts, repetition and near misses."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm.shared_spans import chunk_spans, cut_points, gear_hashes, key_pairs, shared_links, shared_pairs, shared_share, text_classes


def _brute(texts, n=120):
    idx = defaultdict(set)
    for d, t in texts.items():
        for k in range(len(t) - n + 1):
            idx[t[k : k + n]].add(d)
    pairs = {(a, b) for s in idx.values() for a in s for b in s if a < b}
    share = {}
    for d, t in texts.items():
        hit = set()
        for k in range(len(t) - n + 1):
            if len(idx[t[k : k + n]]) > 1:
                hit.update(range(k, k + n))
        share[d] = len(hit)
    return pairs, share


def _texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé漢😀 ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: "".join(word() for _ in range(n))[: n * 4]
    base = prose(200)
    texts = {f"d{k:02}": prose(120) for k in range(12)}
    texts["exact120"] = prose(20) + base[100:220] + prose(20)
    texts["exact119"] = prose(20) + base[300:419] + "§" + prose(20)
    texts["base"] = base
    texts["copy"] = base
    texts["insert"] = base[:300] + "!!" + base[300:]
    texts["run_a"], texts["run_b"] = "-" * 400, prose(10) + "-" * 130
    texts["two_a"], texts["two_b"] = base[:130] + prose(30) + base[500:640], base[500:650] + prose(3) + base[:125]
    texts["short"], texts["empty"] = base[:119], ""
    for k in range(20):
        texts[f"boiler{k:02}"] = prose(15) + "boilerplate of every mail, please read it with care. " * 3 + prose(15)
    return texts


def test_pairs_and_shares_against_brute_force(spark):
    texts = _texts()
    rows = [*texts.items(), ("base", texts["base"]), (None, texts["base"]), ("null", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    pairs, share = _brute(texts)
    got = [tuple(r) for r in shared_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    shares = {r.doc_id: r.shared_chars for r in shared_share(df).collect()}
    assert shares == {**share, "null": 0}
    links = {r.doc_id: (r.class_id, r.copies, r.links) for r in shared_links(df).collect()}
    same = defaultdict(set)
    for d, x in texts.items():
        same[x].add(d)
    assert links == {d: (min(same[x]), len(same[x]), sum(d in p for p in pairs)) for d, x in texts.items()}


def test_passages_of_many_texts_are_joined_in_blocks(spark):
    texts = {f"t{k:03}": f"{k} " + "boilerplate of every mail, please read it with care. " * 3 + str(k) for k in range(60)}
    df = spark.createDataFrame([*texts.items()], "doc_id string, text string")
    found = text_classes(df)[1]
    whole, parts = ({tuple(r) for r in key_pairs(found, block=b).collect()} for b in (2_000, 7))
    assert len(whole) == 60 * 59 / 2 and whole == parts


def test_nothing_shared_and_nothing_at_all(spark):
    df = spark.createDataFrame([("a", "x" * 119), ("b", "x" * 119)], "doc_id string, text string")
    assert shared_pairs(df).count() == 0 and shared_pairs(df.where("false")).count() == 0 and shared_share(df.where("false")).count() == 0
    assert [(r.class_id, r.copies, r.links) for r in shared_links(df).collect()] == [("a", 2, 0)] * 2 and shared_links(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        shared_pairs(df, 60)


def test_gear_hash_sees_64_characters():
    a = np.arange(300, dtype=np.uint32) * 7919 % 1000
    b = a.copy()
    b[:100] = 5
    assert (gear_hashes(a)[100:] == gear_hashes(b)[100:]).all() and (gear_hashes(a)[:37] != gear_hashes(b)[:37]).all()


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(2, 9))
@settings(max_examples=200, deadline=None)
def test_cut_points_are_the_rightmost_least_of_windows(values, w):
    h = np.array(values, np.uint64)
    want = {max(range(s, s + w), key=lambda k: (-values[k], k)) for s in range(len(values) - w + 1)}
    assert set(cut_points(h, w).tolist()) == want


@given(st.text("ab", min_size=120, max_size=140), st.text("abc", max_size=90), st.text("abc", max_size=90), st.text("abc", max_size=90), st.text("abc", max_size=90))
@settings(max_examples=150, deadline=None)
def test_a_shared_run_has_a_shared_chunk(run, a, b, c, d):
    def content(t):
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        return {t[x:y] for x, y in zip(*map(np.ndarray.tolist, chunk_spans(codes, 120)), strict=True)}

    assert content(a + run + b) & content(c + run + d)
