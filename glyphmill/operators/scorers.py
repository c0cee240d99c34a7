"""Authorship-verification scorers over problems (problem_id, known_id, unknown_id).

Problems, repetitions and reference samples are columns of one plan, never loops. All take sentence rows (doc_id, sent_id, tokens).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import small_models
from glyphmill.operators.ngrams import NULL_TOKEN, SEP, token_counts
from glyphmill.operators.numbering import number_rows
from glyphmill.operators.sampling import hash_number
from glyphmill.session import cut

#: Order of the models and repetitions of the methods.
ORDER, REPS = 10, 30

#: Scorers by name, for run_method.
METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    METHODS[f.__name__] = f
    return f


def run_method(name: str, **inputs) -> DataFrame:  # noqa: ANN003
    """Runs a scorer with those of the inputs that it takes."""
    f = METHODS[name]
    wanted = f.__code__.co_varnames[: f.__code__.co_argcount]
    return f(**{k: v for k, v in inputs.items() if k in wanted})


def _reps(problems: DataFrame, known: DataFrame, unknown: DataFrame, refs: DataFrame, order: int, discount: float, kind: str) -> DataFrame:
    if kind not in ("simplified", "full"):
        raise ValueError("kind is simplified or full")
    return small_models.ratios(problems, known, unknown, refs, order, discount, kind == "full")


@method
def lambdag(problems: DataFrame, known: DataFrame, unknown: DataFrame, refs: DataFrame, reps: int = REPS, order: int = ORDER, discount: float = 0.75, kind: str = "simplified") -> DataFrame:
    """``(problem_id, score)``: sum over the unknown tokens of log10(known / reference probability), averaged over the repetitions.

    ``refs`` is (problem_id, rep, tokens), rep from 1. With sampled sentences it is the standard method, with impostor documents, sentences of pooled impostors or the most similar
    sentences its variants; ``kind`` full with discount 0.5 is its second version. Every repetition counts in the divisor.
    """
    return _reps(problems, known, unknown, refs, order, discount, kind).groupBy("problem_id").agg((F.sum("ratio") / reps).alias("score"))


@method
def surprisal(problems: DataFrame, known: DataFrame, unknown: DataFrame, refs: DataFrame, order: int = ORDER, discount: float = 0.75) -> DataFrame:
    """``(problem_id, score)``: share of (token, repetition) where the known model gives more than the reference model."""
    return _reps(problems, known, unknown, refs, order, discount, "simplified").groupBy("problem_id").agg((F.sum("wins") / F.sum("n")).alias("score"))


@method
def entropy_weighted(problems: DataFrame, known: DataFrame, unknown: DataFrame, refs: DataFrame, reps: int = REPS, order: int = ORDER, discount: float = 0.75) -> DataFrame:
    """``(problem_id, score)``: lambdaG of each repetition weighted by reference entropy / known entropy of the padded unigrams."""
    r = _reps(problems, known, unknown, refs, order, discount, "simplified")
    return r.groupBy("problem_id").agg((F.sum(F.col("ratio") * F.col("h_ref") / (F.col("h_known") + 1e-12)) / reps).alias("score"))


def divergences(pairs: DataFrame, p: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(pair_id, jsd, renyi, hellinger)`` in base 2 of two unigram distributions.

    ``pairs`` is (pair_id, left_id, right_id), ``p`` (id, token, p). Both sides are stacked and added up by token, so
    no outer join is needed.
    """
    sides = [pairs.select("pair_id", F.col(f"{s}_id").alias("id")).join(p, "id").select("pair_id", "token", (F.col("p") if s == "left" else F.lit(0.0)).alias("u"), (F.col("p") if s == "right" else F.lit(0.0)).alias("v")) for s in ("left", "right")]
    both = sides[0].unionByName(sides[1]).groupBy("pair_id", "token").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    u, v = F.col("u"), F.col("v")
    m = (u + v) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    mix = F.when((u > 0) & (v > 0), F.pow(u, alpha) * F.pow(v, 1 - alpha)).otherwise(0.0)
    overlap = F.sum(F.when((u > 0) & (v > 0), F.sqrt(u * v)).otherwise(0.0))
    return both.groupBy("pair_id").agg(
        (F.sum(part(u) + part(v)) / 2).alias("jsd"),
        (F.log2(F.greatest(F.sum(mix), F.lit(X.FLOOR))) / (alpha - 1)).alias("renyi"),
        F.sqrt(F.greatest(1 - overlap, F.lit(0.0))).alias("hellinger"),
    )


#: Known documents of a block that the texts compared with them are sent to.
BLOCK_DOCS = 4096


@method
def divergence_scores(problems: DataFrame, known: DataFrame, unknown: DataFrame, ref_docs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(problem_id, jsd, renyi, hellinger)``: mean over the reference documents of divergence(unknown, reference) - divergence(unknown, known).

    ``ref_docs`` is (problem_id, rep, ref_id) with ref_id in ``known``. Known documents stand in blocks by md5, in the order of the ring that samples are arcs of, so a problem's unknown
    text is sent to one or two blocks with the 64-bit hashes of its reference documents' names, and no token of a pair is shuffled. A document that is missing on one side has no tokens.
    """
    def texts(df: DataFrame) -> DataFrame:
        rows = df.where(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", SEP, NULL_TOKEN).alias("_t"))
        return rows.groupBy("doc_id").agg(F.array_join(F.collect_list("_t"), SEP).alias("text"))

    docs = cut(texts(known))
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    block = lambda doc: F.floor(hash_number(F.concat_ws("|", F.lit("0"), doc)) / float(1 << 60) * blocks).cast("int").alias("_block")
    row = lambda text, ident, problem, own, refs: F.struct(text.alias("text"), ident.alias("id"), problem.alias("problem_id"), own.alias("own"), refs.alias("refs"))
    none = lambda kind: F.lit(None).cast(kind)
    kind = problems.schema["problem_id"].dataType.simpleString()
    named = ref_docs.select("problem_id", F.lit(False).alias("own"), F.col("ref_id").alias("_doc")).unionByName(problems.select("problem_id", F.lit(True).alias("own"), F.col("known_id").alias("_doc"))).where("_doc is not null")
    lists = named.select("problem_id", "own", block("_doc"), F.xxhash64("_doc").alias("_h")).repartition("problem_id").groupBy("problem_id", "own", "_block").agg(F.collect_list("_h").alias("refs"))
    asked = lists.join(problems.select("problem_id", F.col("unknown_id").alias("doc_id")), "problem_id").join(texts(unknown), "doc_id", "left")
    rows = docs.select(block("doc_id"), F.lit(0).alias("rep"), row(F.col("text"), F.xxhash64("doc_id"), none(kind), none("boolean"), none("array<bigint>")).alias("v"))
    rows = rows.unionByName(asked.select("_block", F.lit(1).alias("rep"), row(F.col("text"), none("bigint"), F.col("problem_id"), F.col("own"), F.col("refs")).alias("v")))

    def measure(rep: np.ndarray, v: pa.Array) -> dict[str, np.ndarray | list]:
        lists = pc.split_pattern(v.field("text"), SEP)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(lists).dictionary_encode()
        kinds = max(1, len(words.dictionary))
        pairs, n = np.unique(np.repeat(np.arange(len(rep)), size) * kinds + words.indices.to_numpy().astype(np.int64), return_counts=True)
        of, code = pairs // kinds, pairs % kinds
        p = n / size[of]
        begin = np.searchsorted(of, np.arange(len(rep) + 1))
        there = int((rep == 0).sum())
        ids = v.field("id").slice(0, there).to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.argsort(ids)
        refs, whose = v.field("refs").slice(there), v.field("problem_id").slice(there)
        wanted = pc.list_flatten(refs).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.r_[0, np.cumsum(pc.list_value_length(refs).to_numpy(zero_copy_only=False).astype(np.int64))] if len(refs) else np.zeros(1, np.int64)
        spot = by[np.minimum(np.searchsorted(ids, wanted, sorter=by), there - 1)] if there else np.zeros(len(wanted), np.int64)
        found = ids[spot] == wanted if there else np.zeros(len(wanted), bool)
        dense = np.zeros(kinds)
        out = np.zeros((len(refs), 4))
        for k in range(len(refs)):
            mine = slice(begin[there + k], begin[there + k + 1])
            has = bool(size[there + k])
            at, ok = spot[upto[k] : upto[k + 1]], found[upto[k] : upto[k + 1]]
            counted = len(at) if has else int(ok.sum())  # a pair of two missing documents is none
            first, many = begin[at], np.where(ok, begin[at + 1] - begin[at], 0) if len(at) else np.zeros(0, np.int64)
            place = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            dense[code[mine]] = p[mine]
            x, y = dense[code[place]], p[place]
            dense[code[mine]] = 0.0
            both = x > 0
            x, y, g = x[both], y[both], np.repeat(np.arange(len(at)), many)[both]
            total = lambda z: np.bincount(g, z, len(at))  # noqa: B023, E731
            jsd = (float(has) + ok + total(x * np.log2(x / (x + y)) + y * np.log2(y / (x + y)))) / 2
            renyi = np.log2(np.maximum(total(x**alpha * y ** (1 - alpha)), X.FLOOR)) / (alpha - 1)
            hellinger = np.sqrt(np.maximum(1 - total(np.sqrt(x * y)), 0.0))
            use = ok | has
            out[k] = counted, jsd[use].sum(), renyi[use].sum(), hellinger[use].sum()
        kept = np.flatnonzero(out[:, 0] > 0)
        return {"problem_id": whose.take(pa.array(kept)), "own": v.field("own").slice(there).take(pa.array(kept)), "n": out[kept, 0], **{c: out[kept, j + 1] for j, c in enumerate(("jsd", "renyi", "hellinger"))}}

    sums = small_models.by_problem(rows, "v", measure, f"problem_id {kind}, own boolean, n double, jsd double, renyi double, hellinger double", "_block")
    mean = lambda own, c: F.try_divide(F.sum(F.when(F.col("own") == own, F.col(c))), F.sum(F.when(F.col("own") == own, F.col("n"))))
    return sums.groupBy("problem_id").agg(*[(mean(False, c) - mean(True, c)).alias(c) for c in ("jsd", "renyi", "hellinger")])


#: Tokens whose log-probabilities are broadcast, the commonest ones.
HOT_TOKENS = 100_000


def unigram_log_probs(sentences: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, n, sum_lp, avg_lp, perplexity)``: sentences scored by the unigram model of all of them (natural logs).

    Stands where a neural scorer would; a table of another scorer's log-probabilities of the same shape can be used in its place. The commonest tokens are looked up where the sentences stand and
    added up there; only the places of rarer ones are shuffled.
    """
    rows = sentences.select("doc_id", "sent_id", F.explode("tokens").alias("token"))
    freq = cut(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")))
    total = freq.agg(F.sum("c").alias("s")).scalar()
    lp = freq.select("token", F.log(F.col("c") / total).alias("lp"))
    if freq.count() > HOT_TOKENS:
        hot = cut(freq.orderBy(F.desc("c"), "token").limit(HOT_TOKENS)).select("token", F.log(F.col("c") / total).alias("lp"))
        rare = rows.join(F.broadcast(hot.select("token")), "token", "left_anti").join(lp.join(F.broadcast(hot.select("token")), "token", "left_anti"), "token")
    else:
        hot, rare = lp, None
    add = lambda df: df.groupBy("doc_id", "sent_id").agg(F.count(F.lit(1)).alias("n"), F.sum("lp").alias("s"))
    parts = rows.join(F.broadcast(hot), "token").select("doc_id", "sent_id", "lp")
    if rare is None:
        sums = add(parts)
    else:
        sums = add(parts).unionByName(add(rare)).groupBy("doc_id", "sent_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # rounded, so that equal sentences have equal scores whatever the order of summation
    sums = sums.select("doc_id", "sent_id", "n", F.round("s", 12).alias("sum_lp"), F.round(F.col("s") / F.col("n"), 12).alias("avg_lp"))
    return sums.withColumn("perplexity", F.exp(-F.col("avg_lp")))


@method
def no_reference(problems: DataFrame, known: DataFrame, unknown: DataFrame, unknown_scores: DataFrame, order: int = ORDER, discount: float = 0.75) -> DataFrame:
    """``(problem_id, score)``: perplexity of the unknown text under the known full model / its perplexity by the scorer's log-probabilities.

    As in the method's definition the latter raises 2, not e, to the mean of natural logs.
    """
    mine = small_models.perplexities(problems, known, unknown, order, discount)
    by_scorer = unknown_scores.groupBy("doc_id").agg(F.pow(F.lit(2.0), -F.sum("sum_lp") / F.sum("n")).alias("pp"))
    return mine.join(problems.select("problem_id", F.col("unknown_id").alias("doc_id")), "problem_id").join(by_scorer, "doc_id").select("problem_id", (F.col("perplexity") / F.col("pp")).alias("score"))


@method
def perplexity_rank(problems: DataFrame, known_scores: DataFrame, unknown_scores: DataFrame, refs: DataFrame, reps: int = REPS) -> DataFrame:
    """``(problem_id, score)``: for each unknown sentence the sum over known sentences and repetitions of 1 / (rank x reps x K), where the
    rank is the known difference's place among the reference differences (ties first); the document's score is the median.

    ``refs`` is (problem_id, rep, perplexity), rep from 1. A problem's values come to one task; each repetition is sorted once by its differences to an unknown sentence.
    """
    side = lambda df, doc, rep: problems.select("problem_id", F.col(doc).alias("doc_id")).join(df, "doc_id").select("problem_id", F.lit(rep).alias("rep"), "perplexity")
    rows = side(unknown_scores, "unknown_id", small_models.UNKNOWN).unionByName(side(known_scores, "known_id", small_models.KNOWN)).unionByName(refs.select("problem_id", small_models.counted(F.col("rep")).alias("rep"), "perplexity"))

    def measure(rep: np.ndarray, values: pa.Array) -> dict[str, np.ndarray]:
        v = values.to_numpy(zero_copy_only=False)
        u, k = v[rep == small_models.UNKNOWN], v[rep == small_models.KNOWN]
        batches = [v[rep == r] for r in np.unique(rep[rep > small_models.KNOWN])]
        if not len(u) or not len(k) or not batches:
            return {"score": np.zeros(0)}
        score = np.zeros(len(u))
        for j, x in enumerate(u):
            mine = np.abs(x - k)
            for b in batches:
                score[j] += (1.0 / ((np.searchsorted(np.sort(np.abs(x - b)), mine, "left") + 1) * reps * len(k))).sum()
        return {"score": np.array([np.median(score)])}

    return small_models.by_problem(rows, "perplexity", measure, "score double")


@method
def impostors(problems: DataFrame, known_scores: DataFrame, unknown_scores: DataFrame, ref_docs: DataFrame) -> DataFrame:
    """``(problem_id, score)``: mean over the trials of rank / (impostors + 1) of mean(known) - mean(unknown) among the impostors' (1: highest).

    ``ref_docs`` is (problem_id, rep, ref_id); means are over all tokens, rounded to 12 places so that equal texts tie. Lower means closer to the top.
    """
    mean = lambda s, name: s.groupBy("doc_id").agg(F.round(F.sum("sum_lp") / F.sum("n"), 12).alias(name))
    km, um = mean(known_scores, "m"), mean(unknown_scores, "um")
    base = problems.join(um.withColumnRenamed("doc_id", "unknown_id"), "unknown_id").join(km.select(F.col("doc_id").alias("known_id"), F.col("m").alias("km")), "known_id")
    rows = ref_docs.join(km.select(F.col("doc_id").alias("ref_id"), F.col("m").alias("rm")), "ref_id").join(base, "problem_id")
    above = (F.col("rm") - F.col("um") > F.col("km") - F.col("um")).cast("int")
    trials = rows.groupBy("problem_id", "rep").agg(((F.sum(above) + 1) / (F.count(F.lit(1)) + 1)).alias("s"))
    return trials.groupBy("problem_id").agg(F.avg("s").alias("score"))


def wasserstein(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, emd)``: distance of two samples of values, each first divided by its sum; sizes may differ.

    Values of both sides are stacked and sorted once for each key: the area between the two distribution functions. Rounded to 12
    places, so that equal distances tie whatever the order of summation.
    """
    sides = left.select(key, "value", F.lit("a").alias("_side")).unionByName(right.select(key, "value", F.lit("b").alias("_side")))
    one_side = Window.partitionBy(key, "_side")
    weight = F.lit(1.0) / F.count(F.lit(1)).over(one_side)
    stack = sides.select(key, (F.col("value") / F.sum("value").over(one_side)).alias("x"), *[F.when(F.col("_side") == s, weight).otherwise(0.0).alias(f"w{s}") for s in "ab"])
    w = Window.partitionBy(key).orderBy("x")
    step = stack.groupBy(key, "x").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    area = step.select(key, (F.lead("x").over(w) - F.col("x")).alias("gap"), (F.sum("wa").over(w) - F.sum("wb").over(w)).alias("diff"))
    return area.groupBy(key).agg(F.round(F.coalesce(F.sum(F.abs("diff") * F.col("gap")), F.lit(0.0)), 12).alias("emd"))


@method
def distribution_distance(problems: DataFrame, known_scores: DataFrame, unknown_scores: DataFrame, reps: int = 3, seed: str = "0") -> DataFrame:
    """``(problem_id, score)``: distance between the sentences' exp(mean log-probability); of the larger side as many sentences are drawn
    as the smaller has, ``reps`` times in a reproducible order, and the distances averaged. Equal sizes are measured alike in every repetition."""
    k = problems.select("problem_id", F.col("known_id").alias("doc_id")).join(known_scores, "doc_id").select("problem_id", F.lit("k").alias("side"), "sent_id", F.exp("avg_lp").alias("value"))
    u = problems.select("problem_id", F.col("unknown_id").alias("doc_id")).join(unknown_scores, "doc_id").select("problem_id", F.lit("u").alias("side"), "sent_id", F.exp("avg_lp").alias("value"))
    both = k.unionByName(u)
    sizes = both.groupBy("problem_id").agg(F.least(F.count(F.when(F.col("side") == "k", 1)), F.count(F.when(F.col("side") == "u", 1))).alias("size")).where("size > 0")
    rows = both.join(sizes, "problem_id").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    w = Window.partitionBy("problem_id", "rep", "side").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("problem_id").cast("string"), "rep", "sent_id")), "sent_id")
    drawn = cut(rows.withColumn("k", F.row_number().over(w)).where("k <= size").select("problem_id", "side", "value", F.concat_ws("|", F.col("problem_id").cast("string"), "rep").alias("run")))
    emd = wasserstein(drawn.where("side = 'k'"), drawn.where("side = 'u'"), "run")
    names = drawn.select("run", "problem_id").distinct()
    return emd.join(names, "run").groupBy("problem_id").agg(F.avg("emd").alias("score"))


class _Samples:
    """Sorted samples (each divided by its sum), laid end to end, to measure others against. Samples of one size are taken together."""

    #: Cells that are measured in one step rather than quantile by quantile.
    SMALL = 1 << 15

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        begin = np.cumsum(sizes) - sizes
        self.count = len(sizes)
        self.stacks = [(int(n), (at := np.flatnonzero(sizes == n)), values[begin[at][None, :] + np.arange(n)[:, None]]) for n in np.unique(sizes)]  # quantiles by samples
        self.grids: dict[tuple[int, int], tuple] = {}

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances of samples of one size (rows of ``x``) from each of these: areas between their quantile functions."""
        m, out = x.shape[1], np.empty((len(x), self.count))
        for n, at, y in self.stacks:
            if (m, n) not in self.grids:  # where either quantile function steps
                q = np.union1d(np.arange(1, m + 1) * n, np.arange(1, n + 1) * m)
                self.grids[m, n] = (q - 1) // n, (q - 1) // m, np.diff(np.r_[0, q]) / (m * n)
            on_x, on_y, width = self.grids[m, n]
            a, b = x[:, on_x] * width, y[on_y] * width[:, None]
            if a.shape[1] * len(x) * len(at) <= self.SMALL:
                out[:, at] = np.abs(a[:, :, None] - b).sum(axis=1)
                continue
            area = np.zeros((len(x), len(at)))
            part = np.empty_like(area)
            for k in range(len(width)):
                np.subtract(a[:, k, None], b[k], out=part)
                area += np.abs(part, out=part)
            out[:, at] = area
        return out


#: Unknown documents that meet the documents of their corpus in one task, documents of the ring in a row, and cells of (unknown document, document) held at once.
ASKING_DOCS, RING_DOCS, PAIRS = 1024, 4096, 1 << 20


@method
def impostor_distances(problems: DataFrame, known_scores: DataFrame, unknown_scores: DataFrame, pool: DataFrame, share: float = 0.5, draws: int = 100, tests: int = 5, seed: str = "0") -> DataFrame:
    """``(problem_id, test, emd_known_unknown, score)``: for each test the mean over ``draws`` of 1 / rank of the known document's distance among a random ``share`` of the impostors'.

    ``problems`` is (problem_id, corpus, known_id, unknown_id, known_author, unknown_author), ``pool`` (doc_id, corpus, author): impostors are the pool's documents of the problem's corpus but those
    of its two authors; without any the score is 0. Documents are samples of their sentences' exp(mean log-probability). Every unknown document is measured against its corpus once. The impostors of a problem stand on a
    ring by md5; a draw is an arc from a place of its own, and how many nearer ones it holds follows from running totals at its two ends.

    Every unknown document against all of its corpus is the method's work, but no pair is a row: unknown documents come to a task in blocks with the samples of their corpus in ring order, and
    what leaves it are the tests' scores. A task holds its corpus's samples (some hundred bytes a document) and the distances of a part of its unknown documents.
    """
    value = F.exp("avg_lp").alias("value")
    of = lambda doc, scores: problems.select("problem_id", F.col(doc).alias("doc_id")).join(scores.select("doc_id", value), "doc_id").select("problem_id", "value")
    ku, uu = cut(of("known_id", known_scores)), cut(of("unknown_id", unknown_scores))
    own = wasserstein(uu, ku, "problem_id").join(ku.select("problem_id").distinct(), "problem_id", "left_semi").join(uu.select("problem_id").distinct(), "problem_id", "left_semi")
    mine = cut(own.join(problems, "problem_id").select("problem_id", "corpus", F.col("unknown_id").alias("doc_id"), "known_author", "unknown_author", F.col("emd").alias("ku")))
    sample = lambda scores: scores.groupBy("doc_id").agg(F.sort_array(F.collect_list(value)).alias("v"))
    author = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    asked = F.struct("problem_id", F.concat_ws("|", F.lit(seed), F.col("problem_id").cast("string")).alias("name"), "ku", author("known_author").alias("a"), author("unknown_author").alias("b"))
    asking = mine.where("corpus is not null").groupBy("corpus", "doc_id").agg(F.collect_list(asked).alias("asked"))
    blocks = cut(asking.groupBy("corpus").agg(F.ceil(F.count(F.lit(1)) / ASKING_DOCS).cast("int").alias("_n")))  # one row a corpus
    parts = 4 * (blocks.agg(F.sum("_n")).first()[0] or 1)
    block = lambda k: F.concat_ws("|", k.cast("string"), "corpus").alias("_block")
    row = lambda v, a, asked: F.struct(v.alias("v"), a.alias("a"), asked.alias("asked")).alias("v")
    left = asking.join(sample(unknown_scores), "doc_id").join(blocks, "corpus")
    left = left.select(block(F.pmod(F.xxhash64("doc_id"), F.col("_n"))), F.lit(0).alias("rep"), row(F.array("v"), F.lit(None).cast("array<bigint>"), F.col("asked")))
    docs = pool.where("corpus is not null").join(sample(known_scores), "doc_id").select("corpus", F.struct(F.md5(F.concat_ws("|", F.lit(seed), "doc_id")).alias("h"), "doc_id", "v", author("author").alias("a")).alias("doc"))
    pieces = docs.groupBy("corpus").agg(F.ceil(F.count(F.lit(1)) / RING_DOCS).cast("int").alias("_pieces"))  # one row a corpus
    piece = F.floor(F.conv(F.substring("doc.h", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("_pieces")).cast("int")  # an arc of the ring
    ring = docs.join(pieces, "corpus").groupBy("corpus", (piece + 1).alias("rep")).agg(F.sort_array(F.collect_list("doc")).alias("docs")).join(blocks, "corpus")
    ring = ring.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    right = ring.select(block(F.col("_k")), "rep", row(F.col("docs.v"), F.col("docs.a"), F.lit(None).cast(asking.schema["asked"].dataType)))
    each = [f"|{k}".encode() for k in range(draws * tests)]

    def measure(rep: np.ndarray, v: pa.Array) -> dict[str, np.ndarray | list]:
        there = int((rep == 0).sum())
        samples = pc.list_flatten(v.field("v"))
        sizes = pc.list_value_length(samples).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(samples).to_numpy(zero_copy_only=False)
        values = values / np.repeat(np.add.reduceat(values, np.cumsum(sizes) - sizes), sizes)
        upto = int(sizes[:there].sum())
        docs = _Samples(values[upto:], sizes[there:])
        whose = pc.list_flatten(v.field("a").slice(there))
        named = np.flatnonzero(whose.is_valid().to_numpy(zero_copy_only=False))
        codes = whose.fill_null(0).to_numpy(zero_copy_only=False)
        named = named[np.argsort(codes[named], kind="stable")]  # places on the ring by author
        codes = codes[named]
        lists = v.field("asked").slice(0, there)
        asked = pc.list_flatten(lists)
        first = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]
        names, near_to = asked.field("name").to_pylist(), asked.field("ku").to_numpy(zero_copy_only=False) - 5e-13  # both distances count to 12 places
        fences = list(zip(asked.field("a").to_pylist(), asked.field("b").to_pylist(), strict=True))
        scores = np.zeros((len(names), tests))
        met = np.zeros(len(names), bool)
        begin = np.cumsum(sizes[:there]) - sizes[:there]

        def score(j: int, far: np.ndarray) -> None:
            fenced = [named[np.searchsorted(codes, c, "left") : np.searchsorted(codes, c, "right")] for c in dict.fromkeys(fences[j]) if c is not None]
            out = np.sort(np.concatenate([*fenced, np.zeros(0, np.int64)]))
            m = docs.count - len(out)
            if m == 0:
                return
            near = far < near_to[j]
            near[out] = False
            total = np.cumsum(near, dtype=np.int32)
            before = out - np.arange(len(out))
            at = lambda place: total[place + np.searchsorted(before, place, "right")]  # noqa: E731  # place among the impostors to place on the ring
            k = max(math.floor(m * share + 0.5), 1)
            name = names[j].encode()
            number = np.frombuffer(b"".join([hashlib.md5(name + x).digest() for x in each]), ">u8")[::2] >> np.uint64(4)  # as hash_number
            s = (number % np.uint64(m)).astype(np.int64)
            e = s + k - 1
            inside = at(e % m) - np.where(s > 0, at(np.maximum(s - 1, 0)), 0) + np.where(e >= m, total[-1], 0)
            scores[j] = (1.0 / (1 + inside)).reshape(tests, draws).sum(axis=1) / draws
            met[j] = True

        if docs.count:
            size = max(1, min(32, PAIRS // docs.count))
            for n in np.unique(sizes[:there]):
                same = np.flatnonzero(sizes[:there] == n)
                for lo in range(0, len(same), size):
                    some = same[lo : lo + size]
                    for i, far in zip(some.tolist(), docs.distances(values[begin[some][:, None] + np.arange(n)]), strict=True):
                        for j in range(first[i], first[i + 1]):
                            score(j, far)
        kept = np.flatnonzero(met)
        return {"problem_id": asked.field("problem_id").take(pa.array(np.repeat(kept, tests))), "test": np.tile(np.arange(1, tests + 1, dtype=np.int32), len(kept)), "score": scores[kept].reshape(-1)}

    kind = problems.schema["problem_id"].dataType.simpleString()
    scores = small_models.by_problem(left.unionByName(right), "v", measure, f"problem_id {kind}, test int, score double", "_block", parts).drop("_block")
    every = mine.select("problem_id", "ku", F.explode(F.sequence(F.lit(1), F.lit(tests))).alias("test"))
    return every.join(scores, ["problem_id", "test"], "left").select("problem_id", "test", F.col("ku").alias("emd_known_unknown"), F.coalesce("score", F.lit(0.0)).alias("score"))


@method
def verification(problems: DataFrame, known_scores: DataFrame, unknown_scores: DataFrame, ref_docs: DataFrame) -> DataFrame:
    """``(problem_id, known_llr, unknown_llr)``: mean log-probability of the known document and of the unknown one, each less the mean over the impostor documents' means."""
    mean = lambda s, name: s.groupBy("doc_id").agg((F.sum("sum_lp") / F.sum("n")).alias(name))
    km, um = mean(known_scores, "m"), mean(unknown_scores, "u")
    imp = ref_docs.join(km.withColumnRenamed("doc_id", "ref_id"), "ref_id").groupBy("problem_id").agg(F.avg("m").alias("i"))
    rows = problems.join(km.select(F.col("doc_id").alias("known_id"), F.col("m").alias("k")), "known_id").join(um.withColumnRenamed("doc_id", "unknown_id"), "unknown_id").join(imp, "problem_id")
    return rows.select("problem_id", (F.col("k") - F.col("i")).alias("known_llr"), (F.col("u") - F.col("i")).alias("unknown_llr"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length; a zero vector raises."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    size = np.linalg.norm(m, axis=1)
    if (size == 0).any():
        raise ValueError("cosine similarity of a zero vector")
    return m / size[:, None]


def nearest(queries: DataFrame, pool: DataFrame, n: int = 5, block_rows: int = 8192) -> DataFrame:
    """``(query_id, item_id, similarity, rank)``: the n nearest of ``pool`` (item_id, vector) to each of ``queries`` (query_id, vector) by cosine, exactly.

    Ties (of similarities rounded to 12 places) go to the smaller item; an item never is its own neighbour; zero vectors raise, null ones are left out. If the pool has an ``author`` and the queries ``not_a`` and
    ``not_b``, items of these authors do not count. The stated queries meet the pool block by block: a task multiplies one block of each, of about ``block_rows`` rows, and keeps
    n rows a query, which are then merged. The smaller side is the one that is sent to every block of the other.
    """
    fenced = "author" in pool.columns and {"not_a", "not_b"} <= set(queries.columns)
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "item_id": pool.schema["item_id"].dataType.simpleString()}

    def blocks(df: DataFrame, ident: str, block: str, *more: str) -> tuple[DataFrame, int]:
        rows = df.where(F.col(ident).isNotNull() & F.col("vector").isNotNull()).select(ident, "vector", *(more if fenced else ()))
        count = max(1, -(-rows.count() // block_rows))
        part = F.pmod(F.xxhash64(ident), F.lit(count)).cast("int").alias(block)
        return rows.groupBy(part).agg(F.collect_list(F.struct(*rows.columns)).alias(f"{block}s")), count

    q, n_q = blocks(queries, "query_id", "q", "not_a", "not_b")
    p, n_p = blocks(pool, "item_id", "p", "author")
    every = lambda df, c, k: df.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    met = every(q, "p", n_p).join(p, "p") if n_q <= n_p else every(p, "q", n_q).join(q, "q")

    def score(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for k in range(b.num_rows):
                mine, items = (b.column(j).slice(k, 1).flatten() for j in (0, 1))
                who, what = mine.field("query_id"), items.field("item_id")
                names = pa.concat_arrays([what, who.cast(what.type)]).dictionary_encode().indices.to_numpy(zero_copy_only=False) if kinds["query_id"] == kinds["item_id"] else None
                order = np.argsort(np.array(what.to_pylist(), dtype=object), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                a, c = _matrix(mine.field("vector")), _matrix(items.field("vector"))
                if fenced:
                    codes = pa.concat_arrays([items.field("author"), mine.field("not_a"), mine.field("not_b")]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    author, not_a, not_b = np.split(codes, [len(items), len(items) + len(mine)])
                for lo in range(0, len(mine), 512):
                    s = a[lo : lo + 512] @ c.T
                    if names is not None:
                        s[names[None, : len(what)] == names[len(what) + lo : len(what) + lo + len(s), None]] = -np.inf
                    if fenced:
                        for fence in (not_a, not_b):
                            f = fence[lo : lo + 512, None]
                            s[(f == author[None, :]) & (f >= 0)] = -np.inf
                    least = np.partition(s, -n, axis=1)[:, -n] if s.shape[1] > n else np.full(len(s), -np.inf)
                    row, col = np.nonzero((s >= least[:, None] - 1e-9) & np.isfinite(s))
                    near = np.round(s[row, col], 12)
                    best = np.lexsort((place[col], -near, row))
                    row, col, near = row[best], col[best], near[best]
                    first = np.searchsorted(row, row)
                    kept = np.arange(len(row)) - first < n
                    row, col, near = row[kept], col[kept], near[kept]
                    yield pa.RecordBatch.from_arrays([who.take(pa.array(row + lo)), what.take(pa.array(col)), pa.array(near)], names=["query_id", "item_id", "similarity"])

    parts = met.select("qs", "ps").mapInArrow(score, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Vectors that ask in one task, and items of a piece of the pool that passes by.
ASKING_VECTORS, PIECE_ITEMS = 16384, 4096


def _packed(df: DataFrame) -> DataFrame:
    """``df`` with ``vec`` in place of ``vector``: counts up to 255 take a byte each, other numbers eight. Rows of null vectors are left out."""
    names = [c for c in df.columns if c != "vector"]

    def pack(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if b.num_rows:
                m = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                with np.errstate(invalid="ignore"):
                    small = m.astype(np.uint8)
                vec = [b"b" + s.tobytes() if ok else b"d" + x.tobytes() for s, x, ok in zip(small, m, (small == m).all(axis=1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vec, pa.binary())], names=[*names, "vec"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]
    return df.where("vector is not null").select(*names, "vector").mapInArrow(pack, ", ".join([*kinds, "vec binary"]))


def _unpacked(vec: pa.Array) -> np.ndarray:
    """Rows of unit length; a zero vector raises."""
    rows = vec.to_pylist()
    if all(r[:1] == b"b" for r in rows):
        m = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:].astype(float)
    else:
        m = np.stack([np.frombuffer(r[1:], np.uint8 if r[:1] == b"b" else float).astype(float) for r in rows])
    size = np.linalg.norm(m, axis=1)
    if (size == 0).any():
        raise ValueError("cosine similarity of a zero vector")
    return m / size[:, None]


class _Near:
    """The n nearest items of each asked (vector, fence) while the pool passes by.

    Single precision tells which items may be among a vector's nearest; these are measured in full. What an item must reach is the n-th similarity so far among the items that none of the vector's fences keeps out, which
    is never more than any fence's own n-th.
    """

    SLACK = 2e-5  # beyond the error of single precision

    def __init__(self, vec: pa.Array, asked: list, n: int):
        self.whole, self.n, self.asked = _unpacked(vec), n, asked
        self.single = self.whole.astype(np.float32)
        self.fences = [{c for _, x, y in rows for c in (x, y) if c is not None} for rows in asked]
        pairs = [(i, c) for i, f in enumerate(self.fences) for c in f]
        self.fence_row, self.fence_code = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.least = np.full(len(asked), -2.0, np.float32)
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)]  # row, item, similarity, author, has an author
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def meet(self, items: np.ndarray, vec: pa.Array, author: pa.Array) -> None:
        whole = _unpacked(vec)
        single = np.ascontiguousarray(whole.astype(np.float32).T)
        named, codes = author.is_valid().to_numpy(zero_copy_only=False), author.fill_null(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(self.single), 256):
            s = self.single[lo : lo + 256] @ single
            flat = np.flatnonzero(s >= self.least[lo : lo + 256, None])
            if len(flat):
                row, col = flat // s.shape[1] + lo, flat % s.shape[1]
                if len(flat) > 1 << 18:  # nothing is known yet: the best of this piece are enough, and all that equal them
                    k = 2 * self.n + 64
                    if s.shape[1] > k:
                        free = [self._free(i, codes, named) for i in range(lo, lo + len(s))]
                        low = np.array([np.partition(x[f], -self.n)[-self.n] if f.sum() >= self.n else -2.0 for x, f in zip(s, free, strict=True)], np.float32) - self.SLACK
                        keep = s[row - lo, col] >= low[row - lo]
                        row, col = row[keep], col[keep]
                self.new.append([row, items[col], np.round(np.einsum("ij,ij->i", self.whole[row], whole[col]), 12), codes[col], named[col]])
                self.waiting += len(row)
        if self.waiting > 1 << 20 or self.waiting > len(self.single) * self.n:
            self.settle()

    def _free(self, i: int, codes: np.ndarray, named: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), bool)
        for c in self.fences[i]:
            out &= ~(named & (codes == c))
        return out

    def _fenced(self, row: np.ndarray, code: np.ndarray, named: np.ndarray) -> np.ndarray:
        if not len(self.fence_row):
            return np.zeros(len(row), bool)
        kinds, inverse = np.unique(np.concatenate([self.fence_code, code]), return_inverse=True)
        key = np.concatenate([self.fence_row, row]) * len(kinds) + inverse.reshape(-1)
        return np.isin(key[len(self.fence_row) :], key[: len(self.fence_row)]) & named

    def settle(self) -> None:
        """Merges what has come, by row, similarity and item, and raises what items must reach."""
        if not self.new:
            return
        row, item, near, code, named = (np.concatenate([h, *(x[k] for x in self.new)]) for k, h in enumerate(self.held))
        self.new, self.waiting = [], 0
        order = np.lexsort((item, -near, row))
        row, item, near, code, named = (x[order] for x in (row, item, near, code, named))
        free = np.flatnonzero(~self._fenced(row, code, named))
        place = np.arange(len(free)) - np.searchsorted(row[free], row[free])
        last = free[place == self.n - 1]
        least = np.full(len(self.least), -2.0)
        least[row[last]] = near[last]
        upto = np.full(len(self.least), len(row))
        upto[row[last]] = last
        self.least = np.maximum(self.least, (least - self.SLACK).astype(np.float32))
        keep = np.arange(len(row)) <= upto[row]
        self.held = [x[keep] for x in (row, item, near, code, named)]

    def found(self):  # noqa: ANN201
        """(query, its items) of every question."""
        self.settle()
        row, item, _, code, named = self.held
        edges = np.searchsorted(row, np.arange(len(self.asked) + 1))
        for i, questions in enumerate(self.asked):
            mine = slice(edges[i], edges[i + 1])
            for q, x, y in questions:
                ok = np.ones(edges[i + 1] - edges[i], bool)
                for c in (x, y):
                    if c is not None:
                        ok &= ~(named[mine] & (code[mine] == c))
                yield q, item[mine][ok][: self.n]


def near_items(queries: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """``(query, item)``: the n nearest of ``pool`` (item bigint, author, vec) to each of ``queries`` (query bigint, not_a, not_b, vec; vectors as ``_packed``) by cosine, exactly; items of the two authors do not count.

    Ties (of similarities rounded to 12 places) go to the smaller item; zero vectors raise. All queries against all items is the work asked for: queries of one vector ask once, blocks of them
    come to a task, the pool passes by in pieces, and only the nearest leave it.
    """
    code = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    asked = cut(queries.groupBy("vec").agg(F.collect_list(F.struct("query", code("not_a").alias("a"), code("not_b").alias("b"))).alias("asked")))
    blocks = max(1, -(-asked.count() // ASKING_VECTORS))
    doc = F.struct("item", "vec", code("author").alias("a"))
    pieces = pool.groupBy((F.floor(F.col("item") / PIECE_ITEMS) + 1).cast("int").alias("rep")).agg(F.sort_array(F.collect_list(doc)).alias("items"))
    every = pieces.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = F.lit(None)
    rows = asked.select(F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("_block"), F.lit(0).alias("rep"), "vec", "asked", none.cast("array<bigint>").alias("items"), none.cast("array<binary>").alias("vecs"), none.cast("array<bigint>").alias("authors"))
    rows = rows.unionByName(every.select("_block", "rep", none.cast("binary").alias("vec"), none.cast(asked.schema["asked"].dataType).alias("asked"), F.col("items.item").alias("items"), F.col("items.vec").alias("vecs"), F.col("items.a").alias("authors")))

    def run(batches):  # noqa: ANN001, ANN202
        at, vec, asked, near = None, [], [], None

        def give(near: _Near):  # noqa: ANN202
            got = list(near.found())
            for lo in range(0, len(got), 4096):
                some = got[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.int64()))], names=["query", "items"])

        for b in batches:
            c = dict(zip(b.schema.names, b.columns, strict=True))
            for k, (block, rep) in enumerate(zip(c["_block"].to_pylist(), c["rep"].to_pylist(), strict=True)):
                if block != at:
                    if near is not None:
                        yield from give(near)
                    at, vec, asked, near = block, [], [], None
                if rep == 0:
                    vec.append(c["vec"][k].as_py())
                    asked.append([(r["query"], r["a"], r["b"]) for r in c["asked"][k].as_py()])
                elif asked:
                    if near is None:
                        near = _Near(pa.array(vec, pa.binary()), asked, n)
                    near.meet(*(x if j else x.to_numpy(zero_copy_only=False) for j, x in enumerate(c[name].slice(k, 1).flatten() for name in ("items", "vecs", "authors"))))
        if near is not None:
            yield from give(near)

    ordered = rows.repartition(4 * blocks, "_block").sortWithinPartitions("_block", "rep")
    return ordered.mapInArrow(run, "query bigint, items array<bigint>").select("query", F.explode("items").alias("item"))


def similar_sentences(problems: DataFrame, sentences: DataFrame, n: int = REPS, reps: int = REPS, seed: str = "0", strict: bool = True) -> DataFrame:
    """``(problem_id, rep, sent_id)``: for each repetition and each sentence of the known document one of its ``n`` nearest sentences of other authors, no text twice in a repetition.

    ``problems`` is (problem_id, known_id, known_author, unknown_author), ``sentences`` (doc_id, author, sent_id, tokens, vector). Problems of one known document and unknown author ask once. A problem whose known
    sentences cannot all have a text of their own raises or, if not ``strict``, has no row.
    """
    rows = sentences.select("doc_id", "author", "sent_id", "vector", F.md5(X.joined(F.col("tokens"))).alias("text"))
    rows = number_rows(_packed(rows), "item", "sent_id")  # in the order of sent_id, which ties follow
    fence = problems.select("known_id", "known_author", "unknown_author").distinct().withColumnRenamed("known_id", "doc_id")
    asked = rows.select("doc_id", "sent_id", "vec").join(fence, "doc_id").withColumn("query", F.monotonically_increasing_id())
    asked = cut(asked)
    near = near_items(asked.select("query", F.col("known_author").alias("not_a"), F.col("unknown_author").alias("not_b"), "vec"), rows.select("item", "author", "vec"), n)
    # of equal texts that a sentence is offered the first stands for all
    offered = near.join(rows.select("item", "text", "sent_id"), "item").groupBy("query", F.col("text").alias("item_id")).agg(F.min("sent_id").alias("sent_id"))
    offered = offered.groupBy("query").agg(F.collect_list(F.struct("item_id", "sent_id")).alias("offers"))
    name = F.concat_ws("|", "sent_id", F.coalesce("known_author", F.lit("")), F.coalesce("unknown_author", F.lit(""))).alias("query_id")
    whose = asked.select("query", name, F.col("doc_id").alias("known_id"), F.col("known_author").alias("_a"), F.col("unknown_author").alias("_b"))
    mine = offered.join(whose, "query").join(problems.select("problem_id", "known_id", "known_author", "unknown_author"), "known_id").where(F.col("_a").eqNullSafe(F.col("known_author")) & F.col("_b").eqNullSafe(F.col("unknown_author")))
    neighbours = mine.select("problem_id", "query_id", F.explode("offers").alias("o")).select("problem_id", "query_id", "o.item_id", "o.sent_id")
    return similar_references(neighbours, reps, seed, strict).select("problem_id", "rep", "sent_id")


def similar_references(neighbours: DataFrame, reps: int = 3, seed: str = "0", strict: bool = True) -> DataFrame:
    """``(problem_id, rep, query_id, item_id)``, rep from 1: for each query of a problem one of its neighbours, no item twice in a repetition.

    ``neighbours`` is (problem_id, query_id, item_id); a string ``sent_id`` beside them is given with the pick. Queries choose in turn in an order given by md5, from a place of their own in their neighbours' order; one left without a free neighbour
    takes over by augmenting paths, and a repetition without any full assignment raises, or, if not ``strict``, leaves its problem without any row. A problem's queries are its known
    sentences, so a group is one document's size.
    """
    import sys

    import pandas as pd

    more = ["sent_id"] if "sent_id" in neighbours.columns else []
    names = ["problem_id", "rep", "query_id", "item_id", *more]

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        problem, out = g["problem_id"].iloc[0], []
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * len(g) + 1000))  # a chain of moves may pass every query
        number = lambda *p: int(hashlib.md5("|".join(map(str, (seed, problem, *p))).encode()).hexdigest()[:15], 16)
        options = {k: sorted(x["item_id"].tolist(), key=lambda i: number(k, i)) for k, x in g.groupby("query_id")}  # noqa: B023
        sent = dict(zip(zip(g["query_id"], g["item_id"], strict=True), g["sent_id"], strict=True)) if more else {}
        for rep in range(1, reps + 1):
            first = {q: number(rep, q) for q in options}
            taken: dict = {}

            def place(q, seen: set) -> bool:  # noqa: ANN001
                at = first[q] % len(options[q])  # noqa: B023
                for item in options[q][at:] + options[q][:at]:
                    if item in seen:
                        continue
                    seen.add(item)
                    if item not in taken or place(taken[item], seen):  # noqa: B023
                        taken[item] = q  # noqa: B023
                        return True
                return False

            for q in sorted(options, key=first.__getitem__):
                if not place(q, set()):
                    if strict:
                        raise ValueError(f"problem {problem}: no references without repetition")
                    return pd.DataFrame([], columns=names)
            out += [(problem, rep, q, item, *(sent[q, item] for _ in more)) for item, q in taken.items()]
        return pd.DataFrame(out, columns=names)

    kinds = {c: neighbours.schema[c].dataType.simpleString() for c in ("problem_id", "query_id", "item_id")}
    return neighbours.groupBy("problem_id").applyInPandas(assign, f"problem_id {kinds['problem_id']}, rep int, query_id {kinds['query_id']}, item_id {kinds['item_id']}" + ", sent_id string" * len(more))
