"""Kneser-Ney models of document size, many for one question, without a gram in any shuffle.

A verification problem asks one unknown document under the model of the known document and under one model a repetition. These models are as small as a
document and each is asked once, so their grams are never made tables: the sentences of a problem come to one task, sentence by sentence in the order of the
models, and what the unknown text asks for is looked up there on arrays. Contexts are followed from the last word to longer ones; at each length only the places
of a model are kept whose context the unknown text asks for, and only the questions whose context the model knows, so orders beyond a few words cost next to nothing.
What a task holds is one problem: its two documents and its samples. Models of any size are tables (``lm``); both give the same probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import FLOOR, PAD_END, PAD_START

#: ``rep`` of the unknown sentences and of the known model among a problem's rows; repetitions count from 1.
UNKNOWN, KNOWN = -1, 0


def _find(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of the asked keys, 0 where there is none; ``keys`` ascending."""
    if not len(keys):
        return np.zeros(asked.shape)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0).astype(float)


class Padded:
    """Sentences laid end to end with ``order`` - 1 start marks and one end mark each: token codes, the model of each place and its place in the sentence."""

    def __init__(self, model: np.ndarray, lengths: np.ndarray, codes: np.ndarray, order: int):
        starts = order - 1
        size = lengths + starts + 1
        sentence = np.repeat(np.arange(len(lengths)), size)
        self.at = np.arange(len(sentence)) - np.repeat(np.cumsum(size) - size, size)
        self.model, self.sentence = model[sentence], sentence
        self.tokens = np.ones(len(sentence), np.int64)  # 0 is the start mark, 1 the end mark
        self.tokens[self.at < starts] = 0
        self.tokens[(self.at >= starts) & (self.at < starts + lengths[sentence])] = codes + 2
        self.kinds = int(codes.max(initial=-1)) + 3


def probabilities(x: Padded, models: int, order: int, discount: float, full: bool) -> np.ndarray:
    """Probability of every token and end mark of the unknown sentences (rows of model UNKNOWN) under models 0..``models`` - 1: an array of models by places."""
    tokens, t = x.tokens, x.kinds
    asked = np.flatnonzero((x.model == UNKNOWN) & (x.at >= order - 1))
    word = tokens[asked]
    own = np.flatnonzero(x.model >= 0)
    m = x.model[own]
    each = np.arange(models)
    # one word: by distinct words on its left
    second = own[x.at[own] >= 1]
    pairs = np.unique((x.model[second] * t + tokens[second]) * t + tokens[second - 1])
    left_keys, left = np.unique(pairs // t, return_counts=True)
    bigrams = np.bincount(pairs // (t * t), minlength=models).astype(float)
    pre = _find(left_keys, left, each[:, None] * t + word[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        if full:
            words = np.bincount(np.unique(m * t + tokens[own]) // t, minlength=models).astype(float)
            v = words + 1
            p = np.where(bigrams[:, None] > 0, np.maximum(pre - discount, 0) / bigrams[:, None] + (discount * words / bigrams / v)[:, None], (1 / v)[:, None])
        else:
            p = np.where(bigrams[:, None] > 0, pre / bigrams[:, None], 0.0)
    place = np.arange(len(asked))  # of the questions still followed
    q_context = np.zeros(len(asked), np.int64)
    own = own[x.at[own] >= 1]
    o_context = np.zeros(len(own), np.int64)
    for k in range(1, order):
        own, o_context = own[x.at[own] >= k], o_context[x.at[own] >= k]
        raw = np.concatenate([q_context * t + tokens[asked[place] - k], o_context * t + tokens[own - k]])
        names, code = np.unique(raw[: len(place)], return_inverse=True)
        if not len(names):
            break
        at = np.minimum(np.searchsorted(names, raw[len(place) :]), len(names) - 1)
        keep = names[at] == raw[len(place) :]
        own, o_context, q_context, n = own[keep], at[keep], code, len(names)
        m, w = x.model[own], tokens[own]
        spot = m * n + o_context
        seen = np.bincount(spot, minlength=models * n).reshape(models, n).astype(float)
        grams, count = np.unique(spot * t + w, return_counts=True)
        follow = np.bincount(grams // t, minlength=models * n).reshape(models, n).astype(float)
        known = seen[:, q_context] > 0
        who, which = np.nonzero(known)
        c = q_context[which]
        key = (who * n + c) * t + word[place[which]]
        if not full or k == order - 1:
            upper = np.maximum(_find(grams, count, key) - discount, 0) / seen[who, c] + discount * follow[who, c] / seen[who, c] * p[who, place[which]]
            p[who, place[which]] = upper
        else:
            inner = x.at[own] >= k + 1
            around_keys = np.unique((spot[inner] * t + w[inner]) * t + tokens[own[inner] - k - 1])
            around = np.bincount(around_keys // (t * t), minlength=models * n).reshape(models, n).astype(float)
            gram_keys, lefts = np.unique(around_keys // t, return_counts=True)
            ok = around[who, c] > 0
            a, b, c, key = who[ok], place[which][ok], c[ok], key[ok]
            p[a, b] = np.maximum(_find(gram_keys, lefts, key) - discount, 0) / around[a, c] + discount * follow[a, c] / around[a, c] * p[a, b]
        going = known.any(axis=0)
        place, q_context = place[going], q_context[going]
    return p


def entropies(x: Padded, models: int) -> np.ndarray:
    """Entropy in bits of each model's padded tokens."""
    own = x.model >= 0
    keys, n = np.unique(x.model[own] * x.kinds + x.tokens[own], return_counts=True)
    who = keys // x.kinds
    share = n / np.bincount(who, n, models)[who]
    return -np.bincount(who, share * np.log2(share), models)


def by_problem(rows: DataFrame, value: str, measure: Callable[[np.ndarray, pa.Array], dict[str, np.ndarray | list]], schema: str, key: str = "problem_id", parts: int | None = None) -> DataFrame:
    """Runs ``measure`` on each problem's rows (``key``, rep, ``value``), which come to one task in the order of ``rep``; a problem is read as it streams by and given up at its end.

    ``measure`` takes the repetitions and the values and gives columns after ``key`` by name, all of one length. Few rows that ask for much work are spread over ``parts`` tasks, which adaptive
    execution would else join by their size.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give() -> pa.RecordBatch:
            x = pa.Table.from_batches(held).combine_chunks()
            out = measure(x.column(1).to_numpy(), x.column(2).combine_chunks() if isinstance(x.column(2), pa.ChunkedArray) else x.column(2))
            size = len(out[names[0]])
            return pa.RecordBatch.from_arrays([pa.array([x.column(0)[0].as_py()] * size, x.schema.field(0).type), *(pa.array(out[c]) for c in names)], names=[key, *names])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi == lo:
                    continue
                if held and held[0].column(0)[0].as_py() != ids[lo]:
                    yield give()
                    held.clear()
                held.append(b.slice(lo, hi - lo))
        if held:
            yield give()

    ordered = rows.select(key, "rep", value).repartition(*([parts] if parts else []), key).sortWithinPartitions(key, "rep")
    return ordered.mapInArrow(run, f"`{key}` {kind}, {schema}")


def _padded(model: np.ndarray, tokens: pa.Array, order: int) -> Padded:
    words = pc.list_flatten(tokens).dictionary_encode()
    names = words.dictionary.to_pylist()
    code = np.array([{PAD_START: -2, PAD_END: -1}.get(w, k) for k, w in enumerate(names)], np.int64)  # a mark given as a token is the mark
    codes = code[words.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if names else np.zeros(0, np.int64)
    return Padded(model, pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64), codes, order)


def counted(rep: Column) -> Column:
    """A repetition's number, which must be 1 or more."""
    return F.when(rep >= 1, rep.cast("int")).otherwise(F.raise_error(F.lit("repetitions count from 1")).cast("int"))


def ratios(problems: DataFrame, known: DataFrame, unknown: DataFrame, refs: DataFrame, order: int = 10, discount: float = 0.75, full: bool = False) -> DataFrame:
    """``(problem_id, rep, n, ratio, wins, h_ref, h_known)`` of every repetition: unknown tokens and end marks, the sum of log10(known / reference probability) over them, how often the
    known model gives more, and the entropy of both models' padded tokens.

    ``problems`` is (problem_id, known_id, unknown_id), ``known`` and ``unknown`` (doc_id, tokens) by sentence, ``refs`` (problem_id, rep >= 1, tokens). Problems
    without sentences on one of the sides give no row. Zero probabilities count as the least positive number.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    side = lambda df, doc, rep: problems.select("problem_id", F.col(doc).alias("doc_id")).join(df.select("doc_id", "tokens"), "doc_id").select("problem_id", F.lit(rep).alias("rep"), "tokens")
    rows = side(unknown, "unknown_id", UNKNOWN).unionByName(side(known, "known_id", KNOWN)).unionByName(refs.select("problem_id", counted(F.col("rep")).alias("rep"), "tokens"))

    def measure(rep: np.ndarray, tokens: pa.Array) -> dict[str, np.ndarray]:
        reps, model = np.unique(rep, return_inverse=True)
        none = {c: np.zeros(0, k) for c, k in (("rep", np.int32), ("n", np.int64), ("ratio", float), ("wins", np.int64), ("h_ref", float), ("h_known", float))}
        if len(reps) < 3 or reps[0] != UNKNOWN or reps[1] != KNOWN:
            return none
        x = _padded(model.reshape(-1) - 1, tokens, order)
        p = probabilities(x, len(reps) - 1, order, discount, full)
        p = np.where(p > 0, p, FLOOR)
        h = entropies(x, len(reps) - 1)
        log = np.log10(p)
        return {
            "rep": reps[2:].astype(np.int32), "n": np.full(len(reps) - 2, p.shape[1], np.int64), "ratio": (log[0] - log[1:]).sum(axis=1), "wins": (p[0] > p[1:]).sum(axis=1).astype(np.int64),
            "h_ref": h[1:], "h_known": np.full(len(reps) - 2, h[0]),
        }

    return by_problem(rows, "tokens", measure, "rep int, n bigint, ratio double, wins bigint, h_ref double, h_known double")


def perplexities(problems: DataFrame, known: DataFrame, unknown: DataFrame, order: int = 10, discount: float = 0.75) -> DataFrame:
    """``(problem_id, perplexity)``: 2 to the negative mean log2 of the unknown tokens' probabilities under the full model of the known document."""
    side = lambda df, doc, rep: problems.select("problem_id", F.col(doc).alias("doc_id")).join(df.select("doc_id", "tokens"), "doc_id").select("problem_id", F.lit(rep).alias("rep"), "tokens")
    rows = side(unknown, "unknown_id", UNKNOWN).unionByName(side(known, "known_id", KNOWN))

    def measure(rep: np.ndarray, tokens: pa.Array) -> dict[str, np.ndarray]:
        if rep[0] != UNKNOWN or rep[-1] != KNOWN:
            return {"perplexity": np.zeros(0)}
        p = probabilities(_padded(rep.astype(np.int64), tokens, order), 1, order, discount, True)[0]
        return {"perplexity": np.array([2.0 ** -np.log2(np.where(p > 0, p, FLOOR)).mean()])}

    return by_problem(rows, "tokens", measure, "perplexity double")
