"""N-grams: counts, shared n-grams of document pairs, spans and coverage."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators.running import running
from glyphmill.session import cut, shuffle_partitions


def token_counts(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``(key, token, n, p)``: unigram distribution of each key's tokens; counts are combined before the shuffle."""
    counts = docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("_all"))
    return counts.join(totals, key).select(key, "token", "n", (F.col("n") / F.col("_all")).alias("p"))


SEP = "\u0001"


class Flat:
    """Token lists of an Arrow batch laid end to end, each padded with ``starts`` start marks and ``ends`` end marks."""

    def __init__(self, lists: pa.Array, starts: int = 0, ends: int = 0):
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(lists)
        extended = pa.concat_arrays([values.cast(pa.string()), pa.array([X.PAD_START, X.PAD_END])])
        self.lengths = n + starts + ends
        self.rows = np.repeat(np.arange(len(n)), self.lengths)
        begin = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(self.rows)) - begin[self.rows]
        source = self.at - starts + (np.cumsum(n) - n)[self.rows]
        source = np.where(self.at < starts, len(values), np.where(self.at >= starts + n[self.rows], len(values) + 1, source))
        self.tokens = extended.take(pa.array(source))

    def starts(self, n: int) -> np.ndarray:
        """Places where n tokens of one list begin."""
        return np.flatnonzero(self.at + n <= self.lengths[self.rows])

    def take(self, at: np.ndarray) -> pa.Array:
        return self.tokens.take(pa.array(at))

    def joined(self, at: np.ndarray, n: int) -> pa.Array:
        """The n tokens from each place as one string."""
        if n == 0:
            return pa.array([""] * len(at), pa.string())
        return pc.binary_join_element_wise(*[self.take(at + k) for k in range(n)], SEP) if n > 1 else self.take(at)


def _gram_table(sentences: DataFrame, key: str, order: int, tokens: str = "tokens") -> DataFrame:
    """``(key, n, head, mid, tail, count)``: distinct grams of the padded sentences for n = 1..order in three parts (null where there is none).

    Grams are cut and counted batch by batch in Arrow, so what is shuffled is already combined.
    """
    kind = sentences.schema[key].dataType.simpleString()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Flat(b.column(1), order - 1, 1)
            none = lambda at: pa.nulls(len(at), pa.string())
            for n in range(1, order + 1):
                at = f.starts(n)
                if not len(at):
                    continue
                t = pa.table({
                    "k": b.column(0).take(pa.array(f.rows[at])), "head": f.take(at), "mid": f.joined(at + 1, n - 2) if n > 2 else none(at), "tail": f.take(at + n - 1) if n > 1 else none(at),
                }).group_by(["k", "head", "mid", "tail"]).aggregate([([], "count_all")])
                for x in t.combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [x.column("k"), pa.array(np.full(x.num_rows, n, np.int32)), x.column("head"), x.column("mid"), x.column("tail"), x.column("count_all").cast(pa.int64())],
                        names=[key, "n", "head", "mid", "tail", "c"],
                    )

    rows = sentences.select(key, tokens).mapInArrow(grams, f"`{key}` {kind}, n int, head string, mid string, tail string, c bigint")
    return rows.groupBy(key, "n", "head", "mid", "tail").agg(F.sum("c").alias("count"))


def ngram_counts(sentences: DataFrame, key: str, order: int = 3, tokens: str = "tokens") -> DataFrame:
    """``(key, n, gram, count)`` of the padded sentences for n = 1..order; grams are strings with a separator. Null token lists count as empty ones."""
    return _gram_table(sentences, key, order, tokens).select(key, "n", F.concat_ws(SEP, "head", "mid", "tail").alias("gram"), "count")


def continuation_counts(sentences: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``(key, word, left_contexts, distinct_bigrams)``: in how many bigrams a word is the last, and how many bigram types there are."""
    bigrams = _gram_table(sentences, key, 2, tokens).where("n = 2").select(key, F.col("tail").alias("word"))
    per_word = bigrams.groupBy(key, "word").agg(F.count(F.lit(1)).alias("left_contexts"))
    totals = per_word.groupBy(key).agg(F.sum("left_contexts").alias("distinct_bigrams"))
    return per_word.join(totals, key)


def gram_statistics(sentences: DataFrame, key: str, order: int, tokens: str = "tokens") -> DataFrame:
    """``(key, gram, len, cnt, pre, suc, presuc, ctx)`` for every gram and context of a model.

    cnt: occurrences; pre, suc: distinct words before and after; presuc: distinct pairs around; ctx: occurrences of what it begins.
    Each distinct gram adds to its own row and to those of its suffix, prefix and middle, so one aggregate makes all of them.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def row(length, gram, cnt=zero, pre=zero, suc=zero, presuc=zero, ctx=zero):  # noqa: ANN001, ANN202
        return F.struct(length.cast("int").alias("len"), gram.alias("gram"), cnt.alias("cnt"), pre.alias("pre"), suc.alias("suc"), presuc.alias("presuc"), ctx.alias("ctx"))

    n, head, mid, tail = (F.col(c) for c in ("n", "head", "mid", "tail"))
    longer = n >= 2
    parts = F.array(
        row(n, F.concat_ws(SEP, head, mid, tail), cnt=F.col("count")),
        row(n - 1, F.when(longer, F.concat_ws(SEP, mid, tail)).otherwise(""), pre=one),
        row(n - 1, F.when(longer, F.concat_ws(SEP, head, mid)).otherwise(""), suc=one, ctx=F.col("count")),
        row(n - 2, F.coalesce(mid, F.lit("")), presuc=one),
    )
    rows = _gram_table(sentences, key, order, tokens).select(key, F.explode(parts).alias("g")).select(key, "g.*").where("len >= 0")
    return rows.groupBy(key, "len", "gram").agg(*[F.sum(c).alias(c) for c in ("cnt", "pre", "suc", "presuc", "ctx")])


class Automaton:
    """Suffix automaton of a token sequence: every stretch of it is a path from the start. Built and followed in time linear in the tokens."""

    def __init__(self, tokens: list):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def longest_ending_at(self, tokens: list) -> list[int]:
        """For each place of ``tokens`` the length of the longest stretch ending there that the automaton's sequence has too."""
        state, length, out = 0, 0, []
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if t in self.next[state]:
                state, length = self.next[state][t], length + 1
            else:
                state, length = 0, 0
            out.append(length)
        return out


def shared_runs(a: list, b: list, n: int, include_subgrams: bool = False) -> set[tuple]:
    """The n-grams of length ``n`` or more that two sequences share; unless ``include_subgrams`` without those that stand inside a longer one.

    A shared n-gram is inside no longer one only if it is the longest stretch that ends somewhere in ``a`` and cannot be prolonged there, so the quadratic set of all n-grams is not made.
    """
    upto = Automaton(b).longest_ending_at(a)
    runs = {tuple(a[i + 1 - k : i + 1]) for i, k in enumerate(upto) if k >= n and (i + 1 == len(a) or upto[i + 1] <= k)}
    if include_subgrams:
        return {r[i : i + k] for r in runs for k in range(n, len(r) + 1) for i in range(len(r) - k + 1)}
    inner: set[tuple] = set()
    lengths = sorted({len(r) for r in runs})
    for r in runs:  # what a longer run holds of the lengths that occur
        for k in lengths:
            if k >= len(r):
                break
            inner.update(g for i in range(len(r) - k + 1) if (g := r[i : i + k]) in runs)
    return runs - inner


def common_ngrams(pairs: DataFrame, tokens: DataFrame, n: int = 2, include_subgrams: bool = False) -> DataFrame:
    """``(pair_id, n, gram)``: the n-grams of length ``n`` or more that two documents share; unless ``include_subgrams``, one inside a longer one of the pair is left out.

    ``pairs`` is (pair_id, doc_a, doc_b), ``tokens`` (doc_id, tokens), of words or of any tokenizer. A pair's two documents meet in one row and are compared by a suffix automaton.
    Documents without tokens share nothing; a null pair id is a pair.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kind = pairs.schema["pair_id"].dataType.simpleString()
    side = lambda c: tokens.select(F.col("doc_id").alias(f"doc_{c}"), F.col("tokens").alias(f"_{c}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, grams = [], [], []
            for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for g in sorted(shared_runs(a or [], b or [], n, include_subgrams)):
                    ids.append(k)
                    sizes.append(len(g))
                    grams.append(SEP.join(g))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int32()), pa.array(grams, pa.string())], names=["pair_id", "n", "gram"])

    met = pairs.select("pair_id", "doc_a", "doc_b").join(side("a"), "doc_a").join(side("b"), "doc_b")
    return met.select("pair_id", "_a", "_b").mapInArrow(compare, f"pair_id {kind}, n int, gram string")


def sharing_pairs(tokens: DataFrame, n: int) -> DataFrame:
    """``(pair_id, doc_a, doc_b)``: pairs of documents, a < b, that share any n-gram of length ``n``, by 64-bit hashes of their n-grams; a few pairs more may come.

    All such pairs are the result asked for; documents that share nothing are not paired.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Flat(b.column(1))
            at = f.starts(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(f.rows[at])), f.joined(at, n)], names=["doc_id", "g"])

    rows = tokens.select("doc_id", "tokens").mapInArrow(grams, f"doc_id {kind}, g string").select(F.xxhash64("g").alias("h"), "doc_id").distinct()
    several = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h")
    shared = cut(rows.join(several, "h", "left_semi"))
    met = shared.select("h", F.col("doc_id").alias("doc_a")).join(shared.select("h", F.col("doc_id").alias("doc_b")), "h").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
    return met.select(F.concat_ws("|", "doc_a", "doc_b").alias("pair_id"), "doc_a", "doc_b")


def profile_tokens(rows: DataFrame, owner: str, order: list[str], tokens: str = "tokens") -> DataFrame:
    """``(owner, pos, token)``: every token of an owner's rows, laid end to end in their order, with its place in the whole. An owner of any size stays in rows and is spread over tasks."""
    kept = rows.where(F.col(owner).isNotNull() & F.col(tokens).isNotNull()).select(F.col(owner).alias("owner"), *order, F.col(tokens).alias("_t"))
    placed = running(kept, ["owner"], order, {"_end": F.size("_t").cast("bigint")}, "_rank")
    return placed.select("owner", (F.col("_end") - F.size("_t")).alias("_from"), F.posexplode("_t").alias("_k", "token")).select("owner", (F.col("_from") + F.col("_k")).alias("pos"), "token")


def largest_common_run(pairs: DataFrame, left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """``(pair_id, highest_common_count, ngram)``: the greatest number of tokens in a row, ``least`` or more, that two profiles share, and the first such run by its tokens; pairs that share none give no row.

    ``pairs`` is (pair_id, left_id, right_id), the profiles are (owner, pos, token), of any size. Runs are known by 64-bit hashes. Their length is first doubled while any is shared, each doubling a join of places with the
    places so much further on, then refined by halves: only places that are shared so far are taken on, so after the first step the tables are small.
    """
    def hashes(t: DataFrame) -> DataFrame:
        return cut(t.select("owner", "pos", F.xxhash64("token").alias("h")))

    def doubled(t: DataFrame, step: int) -> DataFrame:
        ahead = t.select("owner", (F.col("pos") - step).alias("pos"), F.col("h").alias("_h"))
        return cut(t.join(ahead, ["owner", "pos"]).select("owner", "pos", F.xxhash64("h", "_h").alias("h")))

    def on_left(rows: DataFrame, grams: DataFrame) -> DataFrame:
        return rows.join(grams.select(F.col("owner").alias("left_id"), "h").distinct(), ["left_id", "h"], "left_semi")

    lefts, rights = [hashes(left)], [hashes(right)]
    found = cut(on_left(pairs.select("pair_id", "left_id", F.col("right_id")).join(rights[0].withColumnRenamed("owner", "right_id"), "right_id"), lefts[0]))
    levels = [found]
    while True:
        step = 1 << (len(lefts) - 1)
        lefts.append(doubled(lefts[-1], step))
        rights.append(doubled(rights[-1], step))
        at = levels[-1].drop("h").join(rights[-1].withColumnRenamed("owner", "right_id"), ["right_id", "pos"])
        found = cut(on_left(at, lefts[-1]))
        if not found.limit(1).count():
            break
        levels.append(found)
    now_r = now_l = None
    above: DataFrame | None = None  # pairs that share longer runs
    for k in reversed(range(len(levels))):
        mine = levels[k] if above is None else levels[k].join(above, "pair_id", "left_anti")
        r = mine.select("pair_id", "left_id", "right_id", "pos", "h", F.lit(1 << k).cast("bigint").alias("n"))
        shared = r.select("pair_id", "left_id", "h", "n").distinct()
        lrows = shared.join(lefts[k].withColumnRenamed("owner", "left_id"), ["left_id", "h"]).select("pair_id", "left_id", "pos", "h", "n")
        now_r, now_l = (r, lrows) if now_r is None else (now_r.unionByName(r), now_l.unionByName(lrows))
        own = levels[k].select("pair_id").distinct()
        above = own if above is None else above.unionByName(own).distinct()
    now_r, now_l = cut(now_r), cut(now_l)
    for k in reversed(range(len(levels) - 1)):
        longer = lambda rows, t, c: rows.withColumn("_p", F.col("pos") + F.col("n")).join(t.select(F.col("owner").alias(c), F.col("pos").alias("_p"), F.col("h").alias("_h")), [c, "_p"]).withColumn("h", F.xxhash64("h", "_h")).withColumn("n", F.col("n") + (1 << k)).drop("_p", "_h")  # noqa: B023, E731
        r, lrows = longer(now_r, rights[k], "right_id"), longer(now_l, lefts[k], "left_id")
        r = cut(r.join(lrows.select("pair_id", "h").distinct(), ["pair_id", "h"], "left_semi"))
        lrows = lrows.join(r.select("pair_id", "h").distinct(), ["pair_id", "h"], "left_semi")
        better = r.select("pair_id").distinct()
        now_r, now_l = (cut(old.join(better, "pair_id", "left_anti").unionByName(new)) for old, new in ((now_r, r), (now_l, lrows)))
    runs = now_r.where(F.col("n") >= least).groupBy("pair_id", "right_id", "h", "n").agg(F.min("pos").alias("pos"))
    places = runs.select("pair_id", "right_id", "h", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("_k"), "pos").withColumn("pos", F.col("pos") + F.col("_k"))
    words = places.join(right.withColumnRenamed("owner", "right_id"), ["right_id", "pos"]).groupBy("pair_id", "h", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "token"))), lambda x: x["token"]).alias("g"))
    return words.groupBy("pair_id", F.col("n").cast("int").alias("highest_common_count")).agg(F.array_join(F.min("g"), " ").alias("ngram"))


#: Tokens of a profile up to which it is laid out in one task; larger ones stay in rows.
PROFILE_TOKENS = 1 << 22
#: Stands for a null token in joined tokens.
NULL_TOKEN = "\u0002"


def _longest_shared(left: np.ndarray, rights: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each of ``rights`` the greatest length of a run that ``left`` has too and the place of the first such run by its codes. Codes are 0 or more.

    All sequences are laid end to end and their suffixes ranked by doubling; the longest match of a suffix is with the nearest suffix of ``left`` on either side of it.
    """
    if not len(left):
        return [(0, 0)] * len(rights)
    top = max(int(x.max()) for x in (left, *rights) if len(x)) + 1
    parts = [left, *rights]
    text = np.concatenate([np.append(x, top + k) for k, x in enumerate(parts)])  # each ends with a mark of its own
    total = len(text)
    ids = [np.unique(text, return_inverse=True)[1].reshape(-1).astype(np.int32)]
    while (most := int(ids[-1].max()) + 1) < total:
        step = 1 << (len(ids) - 1)
        key = ids[-1] * np.int64(most + 1)
        key[: max(total - step, 0)] += ids[-1][step:] + 1
        ids.append(np.unique(key, return_inverse=True)[1].reshape(-1).astype(np.int32))
    order = np.argsort(ids[-1])
    mine = order < len(left)
    spot, length = np.arange(total), np.zeros(total, np.int64)
    before = np.maximum.accumulate(np.where(mine, spot, -1))
    after = np.minimum.accumulate(np.where(mine, spot, total)[::-1])[::-1]
    other = order > len(left)
    for near in (before, after):
        ok = other & (near >= 0) & (near < total)
        a, b = order[ok], order[near[ok]]
        shared = np.zeros(len(a), np.int64)
        for k in reversed(range(len(ids))):
            x, y = a + shared, b + shared
            fits = (x < total) & (y < total)
            same = fits & (ids[k][np.minimum(x, total - 1)] == ids[k][np.minimum(y, total - 1)])
            shared += same * (1 << k)
        length[a] = np.maximum(length[a], shared)
    out, begin = [], len(left) + 1
    for x in rights:
        own = length[begin : begin + len(x)]
        best = int(own.max(initial=0))
        at = np.flatnonzero(own == best)
        out.append((best, int(at[np.argmin(ids[-1][begin + at])]) if best else 0))
        begin += len(x) + 1
    return out


def largest_common_run_of_texts(pairs: DataFrame, left: DataFrame, right: DataFrame, owner: str, order: list[str], tokens: str = "tokens", least: int = 2, most: int = PROFILE_TOKENS) -> DataFrame:
    """``(pair_id, highest_common_count, ngram)`` as ``largest_common_run`` gives, from the owners' texts (owner, *order, tokens), laid end to end in their order.

    The smaller profile of a pair is sent to the larger one, and all that one profile is compared with meet it in one task. Pairs with a profile of more than ``most`` tokens are compared in rows of tokens.
    """
    sides = [t.where(F.col(owner).isNotNull() & F.col(tokens).isNotNull()).select(F.col(owner).alias("owner"), *order, F.col(tokens).alias("_t")) for t in (left, right)]
    lead = order[:-1] or order  # what is sent are joined tokens of whole documents, which stand with their owners
    lines = sides[0].withColumn("_s", F.lit(0)).unionByName(sides[1].withColumn("_s", F.lit(1))).where(F.size("_t") > 0)
    lines = lines.select("_s", "owner", *order, F.size("_t").alias("_k"), F.array_join("_t", SEP, NULL_TOKEN).alias("_t")).repartition(shuffle_partitions(pairs.sparkSession), "_s", "owner")
    parts = lines.groupBy("_s", "owner", *lead).agg(F.sort_array(F.collect_list(F.struct(order[-1], "_t"))).alias("_p"), F.sum("_k").alias("_k"))
    texts = cut(parts.select("_s", "owner", *lead, "_k", F.array_join(F.transform("_p", lambda x: x["_t"]), SEP).alias("_t")))
    sizes = [texts.where(f"_s = {k}").groupBy(F.col("owner").alias(f"{c}_id")).agg(F.sum("_k").alias(f"_{c}")) for k, c in enumerate(("left", "right"))]
    asked = cut(pairs.select("pair_id", "left_id", "right_id").join(sizes[0], "left_id").join(sizes[1], "right_id"))
    rows, fits = None, F.greatest("_left", "_right") <= most
    if (far := asked.where(~fits)).limit(1).count():
        named = [t.join(far.select(F.col(c).alias("owner")).distinct(), "owner", "left_semi") for t, c in zip(sides, ("left_id", "right_id"), strict=True)]
        rows = largest_common_run(far.select("pair_id", "left_id", "right_id"), *[cut(profile_tokens(t, "owner", order, "_t")) for t in named], least)
    kind = pairs.schema["pair_id"].dataType.simpleString()
    at = lambda s, c: F.struct(F.lit(s).alias("s"), F.col(c).alias("owner"))
    turned = F.col("_left") < F.col("_right")
    ends = asked.where(fits).select("pair_id", F.when(turned, at(1, "right_id")).otherwise(at(0, "left_id")).alias("_to"), F.when(turned, at(0, "left_id")).otherwise(at(1, "right_id")).alias("_of"))
    wanted = ends.select("_to", F.lit(1).alias("_side"), "pair_id", "_of").unionByName(ends.select("_to", F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("pair_id"), F.col("_to").alias("_of")).distinct())
    met = wanted.select(F.concat_ws("|", "_to.s", "_to.owner").alias("_to"), "_side", "pair_id", F.col("_of.s").alias("_s"), F.col("_of.owner").alias("owner")).join(texts.drop("_k"), ["_s", "owner"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give() -> Iterator[pa.RecordBatch]:
            x = pa.Table.from_batches(held).combine_chunks()
            side, texts = x.column(1).to_numpy(), pc.split_pattern(pa.concat_arrays(x.column(3).chunks), SEP)
            if side[0] or not side[-1]:
                return
            names_of = pc.fill_null(pa.concat_arrays(x.column(2).chunks).dictionary_encode().indices, -1).to_numpy()
            first = np.r_[0, np.flatnonzero((names_of[1:] != names_of[:-1]) | (side[1:] != side[:-1])) + 1]
            words = pc.list_flatten(texts).dictionary_encode()
            by = pc.sort_indices(words.dictionary)
            names = words.dictionary.take(by).to_pylist()
            code = np.zeros(len(names), np.int64)
            code[by.to_numpy()] = np.arange(len(names))
            codes = code[words.indices.to_numpy()]
            sizes = np.add.reduceat(pc.list_value_length(texts).to_numpy().astype(np.int64), first)
            profiles = np.split(codes, np.cumsum(sizes)[:-1])
            lo, best = 1, []
            while lo < len(profiles):
                hi, size = lo + 1, len(profiles[lo])
                while hi < len(profiles) and size + len(profiles[hi]) <= max(len(profiles[0]) // 2, 1 << 16):
                    size += len(profiles[hi])
                    hi += 1
                best += _longest_shared(profiles[0], profiles[lo:hi])
                lo = hi
            kept = [(k + 1, n, [names[c] for c in profiles[k + 1][at : at + n]]) for k, (n, at) in enumerate(best) if n >= least]
            ids = pa.concat_arrays(x.column(2).chunks).take(pa.array([first[k] for k, _, _ in kept], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n, _ in kept], pa.int32()), pa.array([" ".join(w for w in g if w != NULL_TOKEN) for _, _, g in kept], pa.string())], names=["pair_id", "highest_common_count", "ngram"])

        for b in batches:
            of = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, b.num_rows]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi == lo:
                    continue
                if held and held[0].column(0)[0].as_py() != b.column(0)[lo].as_py():
                    yield from give()
                    held.clear()
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from give()

    ordered = met.select("_to", "_side", "pair_id", "_t", *lead).repartition("_to").sortWithinPartitions("_to", "_side", "pair_id", *lead)
    runs = ordered.select("_to", "_side", "pair_id", "_t").mapInArrow(compare, f"pair_id {kind}, highest_common_count int, ngram string")
    return runs if rows is None else runs.unionByName(rows)


def readable(grams: DataFrame, order: str = "count_desc", sep: str = " ", strip: tuple[str, ...] = ()) -> DataFrame:
    """``(pair_id, place, n, pretty, raw)``: the shared n-grams of each pair in reading order: by how many there are of a length (``count_desc``), or by length (``len_asc``, ``len_desc``), and by tokens within one.

    ``pretty`` joins the tokens without the marks in ``strip``, ``raw`` shows the token tuple, quoted.
    """
    if order not in ("count_desc", "len_asc", "len_desc"):
        raise ValueError("order is count_desc, len_asc or len_desc")
    sizes = grams.groupBy("pair_id", "n").agg(F.count(F.lit(1)).alias("_c"))
    first = {"count_desc": [F.desc("_c"), F.col("n")], "len_asc": [F.col("n")], "len_desc": [F.desc("n")]}[order]
    placed = running(grams.join(sizes, ["pair_id", "n"]), ["pair_id"], [*first, "gram"], rank="place")
    parts = F.split("gram", SEP)
    bare = F.transform(parts, lambda t: functools.reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("")), strip, t))
    return placed.select("pair_id", F.col("place").cast("int").alias("place"), "n", F.array_join(bare, sep).alias("pretty"), X.token_repr(parts).alias("raw"))


def filter_ngrams(grams: DataFrame, word_mode: bool = False) -> DataFrame:
    """N-grams that hold more than one word, by their tokens."""
    return grams.where(X.keeps_ngram(F.split("gram", "\u0001", -1), word_mode=word_mode))


def highest_common(grams: DataFrame) -> DataFrame:
    """``(pair_id, highest_common_count, ngram)``: greatest length shared and the first n-gram of that length by its tokens."""
    best = grams.groupBy("pair_id").agg(F.max("n").alias("highest_common_count"))
    tops = grams.join(best, "pair_id").where("n = highest_common_count")
    return tops.groupBy("pair_id", "highest_common_count").agg(F.replace(F.min("gram"), F.lit("\u0001"), F.lit(" ")).alias("ngram"))


def coverage_runs(text: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, end, cover)``: stretches of a text by how many spans cover them (0 plain, 1 single, 2 or more overlapping).

    ``text`` is (key, length), ``spans`` (key, start, end). Only span edges are sorted, never single characters.
    """
    edges = spans.select(key, F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(spans.select(key, F.col("end").alias("at"), F.lit(-1).alias("step")))
    ends = text.select(key, F.lit(0).alias("at"), F.lit(0).alias("step")).unionByName(text.select(key, F.col("length").cast("int").alias("at"), F.lit(0).alias("step")))
    net = edges.unionByName(ends).groupBy(key, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(key).orderBy("at")
    level = net.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("step").over(w).alias("depth"))
    level = level.where("end is not null and start < end").withColumn("cover", F.least(F.col("depth"), F.lit(2)).cast("int"))
    changed = F.when(F.lag("cover").over(Window.partitionBy(key).orderBy("start")) == F.col("cover"), 0).otherwise(1)
    runs = level.withColumn("_c", changed).withColumn("run", F.sum("_c").over(Window.partitionBy(key).orderBy("start")))
    return runs.groupBy(key, "run", "cover").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(key, "start", "end", "cover")
