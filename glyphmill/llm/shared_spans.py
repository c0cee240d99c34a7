"""Long exact spans shared between records, by content-defined chunking with a gear rolling hash.

Cuts. The 64-bit gear hash h = 2h + G[c] sees exactly the last 64 characters. A cut stands at the (rightmost) least hash of every
window of w hashes, so cuts depend on nearby characters only and resist insertions. A chunk reaches from the 64
characters that made one cut to the next cut. Of any run of ``min_chars`` characters two texts share, 64 + 2w - 1 <= min_chars
gives both the same two successive cuts, hence one equal chunk: no shared run is missed, whatever surrounds it.

Plan. Equal texts are one class, known by their digest, and only one text of each goes on. Chunks are made in the map tasks; their digests are
grouped (map-side minimum and maximum of a 64-bit key), and only digests of more than one text go on. For the shares, every run of exactly
``min_chars`` characters around these chunks gets a 128-bit digest; runs found in more than one text cover what is shared. All of it is linear in the text. For
the pairs only the first chunk of a shared passage matters: a chunk that always follows the same chunk is never first, so
groups of one previous digest are left out, and so are, by previous character, all runs but those at which a passage begins. Texts that
meet in a run are joined in blocks, so a passage of very many texts is no single task. Classes become documents again only at the end: for the shares
and link counts by one row a document, for the pairs, if these are asked for, by their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.deliveries import bitmap, one_delivery, with_bit
from glyphmill.session import cut

GEAR = 64  # characters that a 64-bit gear hash sees
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)  # splitmix64


def _gear_values(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gear_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every run of 64 characters: entry i belongs to codes[i : i + 64]."""
    h, seen = _gear_values(codes), 1
    while seen < GEAR:
        h = h[seen:] + (h[:-seen] << np.uint64(seen))
        seen *= 2
    return h


def cut_points(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost least value of every window of ``w`` values."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    v, i, have = h, np.arange(len(h)), 1
    while have < w:
        step = min(have, w - have)
        left, right = v[:-step], v[step:]
        later = right <= left
        v, i, have = np.where(later, right, left), np.where(later, i[step:], i[:-step]), have + step
    return np.unique(i)


def chunk_spans(codes: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of one text (overlapping by the 64 characters that made the first cut)."""
    cuts = cut_points(gear_hashes(codes), window(min_chars)) if len(codes) >= min_chars else np.zeros(0, np.int64)
    return cuts[:-1], cuts[1:] + GEAR


def window(min_chars: int) -> int:
    w = (min_chars - GEAR + 1) // 2
    if w < 2:
        raise ValueError(f"min_chars must be at least {GEAR + 3}")
    return w


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """``(digest, prev, doc, start, end)``: the chunks of every text of at least ``min_chars`` characters. ``doc`` is a 64-bit key of the id;
    ``prev`` is the digest of the chunk before, for a text's first chunk a value of its document's own."""
    window(min_chars)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, dig, prev, st, en = [], [], [], [], []
            keys = b.column(0).to_numpy().view(np.uint64)
            for k, text in enumerate(b.column(1).to_pylist()):
                codes = _codes(text)
                s, e = chunk_spans(codes, min_chars)
                raw = memoryview(codes.tobytes())
                d = [xxhash.xxh3_64_intdigest(raw[4 * x : 4 * y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                if d:
                    dig += d
                    prev += [int(keys[k]), *d[:-1]]
                    at += [k] * len(d)
                    st.append(s)
                    en.append(e)
            if at:
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [signed(dig), signed(prev), b.column(0).take(pa.array(at)), pa.array(np.concatenate(st), pa.int32()), pa.array(np.concatenate(en), pa.int32())],
                    names=["digest", "prev", "doc", "start", "end"],
                )

    long_enough = docs.where(F.length("text") >= min_chars).select(F.xxhash64("doc_id").alias("doc"), "text")
    return long_enough.mapInArrow(cut, "digest bigint, prev bigint, doc bigint, start int, end int")


def in_several(df: DataFrame, *key: str, heads: str | None = None) -> DataFrame:
    """The keys that stand in more than one document; minimum and maximum are combined before the shuffle, so hot keys are one row a task.

    With ``heads`` only keys at which a passage may begin: what that column says stood before is not one and the same everywhere.
    """
    before = [F.min(heads).alias("b0"), F.max(heads).alias("b1")] if heads else []
    found = df.groupBy(*key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), *before).where("lo <> hi")
    return (found.where("b0 <> b1 or b0 = -1") if heads else found).select(*key)


def shared_runs(docs: DataFrame, min_chars: int = 120, heads: bool = False) -> DataFrame:
    """``(d1, d2, doc, doc_id, pos, before)``: runs of exactly ``min_chars`` characters (by 128-bit digest) that contain a chunk found in several
    texts; all of them, or with ``heads`` those that may begin a shared passage. ``before`` is the character before the
    run, -1 at the start of a text. ``docs`` is (doc_id, text) with equal ids for equal texts; rows of one id are read but once beyond their chunks."""
    found = chunks(docs, min_chars)
    wanted = cut(in_several(found, "digest", heads="prev" if heads else None))
    # a bitmap of fixed size keeps most chunks and texts out of the shuffles; what passes it is joined exactly
    likely = with_bit(found.select("digest", "doc", "start", "end"), "digest", bitmap(wanted, "digest"), "_maybe").where("_maybe")
    spots = cut(likely.join(wanted, "digest", "left_semi").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spots")))
    reach = window(min_chars) - 1 if heads else min_chars  # a passage begins within one window before its first chunk

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, name, text, spans in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                codes = _codes(text)
                last = len(codes) - min_chars
                raw = memoryview(codes.tobytes())
                pos, upto = [], 0
                for x in spans:
                    lo, hi = max(upto, x["end"] - min_chars, x["start"] - reach), min(last, x["start"])
                    pos += range(lo, hi + 1)
                    upto = max(upto, hi + 1)
                if pos:
                    d = b"".join(xxhash.xxh3_128_digest(raw[4 * p : 4 * (p + min_chars)]) for p in pos)
                    halves = np.frombuffer(d, "<i8").reshape(-1, 2)
                    p = np.array(pos)
                    before = np.where(p > 0, codes[np.maximum(p - 1, 0)].astype(np.int64), -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([doc] * len(p), pa.int64()), pa.array([name] * len(p), pa.string()), pa.array(p, pa.int32()), pa.array(before, pa.int32())],
                        names=["d1", "d2", "doc", "doc_id", "pos", "before"],
                    )

    asked = with_bit(docs.withColumn("doc", F.xxhash64("doc_id")), "doc", bitmap(spots, "doc"), "_maybe").where("_maybe")
    texts = one_delivery(asked, "doc_id", "text").select(F.xxhash64("doc_id").alias("doc"), "doc_id", "text").join(spots, "doc")
    return texts.select("doc", "doc_id", "text", "spots").mapInArrow(runs, "d1 bigint, d2 bigint, doc bigint, doc_id string, pos int, before int")


#: Texts of one passage that are joined with one another in one task, at most this many with as many.
BLOCK_TEXTS = 2_000


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(text_key, doc_id)`` of every document with a text, and ``(doc_id, text)`` with the text's key (its MD5) for id."""
    there = docs.where("doc_id is not null and text is not null").select(F.md5("text").alias("text_key"), "doc_id", "text")
    return there.select("text_key", "doc_id").distinct(), there.select(F.col("text_key").alias("doc_id"), "text")


def key_pairs(texts: DataFrame, min_chars: int = 120, block: int = BLOCK_TEXTS) -> DataFrame:
    """``(key_a, key_b)``, a < b: different texts that share ``min_chars`` or more consecutive characters."""
    runs = cut(shared_runs(texts, min_chars, heads=True))  # read twice, as are the heads below
    heads = cut(runs.join(in_several(runs, "d1", "d2", heads="before"), ["d1", "d2"], "left_semi").select("d1", "d2", F.col("doc_id").alias("key"), "before").distinct())
    sizes = heads.groupBy("d1", "d2").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = heads.join(sizes, ["d1", "d2"]).withColumn("own", own)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = rows.select("d1", "d2", F.col("own").alias("i"), every.alias("j"), F.col("key").alias("key_a"), F.col("before").alias("before_a"))
    b = rows.select("d1", "d2", every.alias("i"), F.col("own").alias("j"), F.col("key").alias("key_b"), F.col("before").alias("before_b"))
    met = a.join(b, ["d1", "d2", "i", "j"]).where("key_a < key_b and (before_a <> before_b or before_a = -1)")
    return met.select("key_a", "key_b").distinct()


def shared_pairs(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: documents of which two different ones share ``min_chars`` or more consecutive characters.

    Null ids, null texts and texts shorter than ``min_chars`` are in no pair; repeated deliveries of an id are one document.
    The rows are the result asked for, one for each pair, copies included; ``shared_links`` says the same without them.
    """
    classes, texts = text_classes(docs.where(F.length("text") >= min_chars))
    classes = cut(classes)
    a, b = (classes.select(F.col("text_key").alias(f"key_{x}"), F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    across = key_pairs(texts, min_chars).join(a, "key_a").join(b, "key_b").select("doc_a", "doc_b")
    copied = classes.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key")
    copies = classes.join(copied, "text_key", "left_semi")
    within = copies.select("text_key", F.col("doc_id").alias("doc_a")).join(copies.select("text_key", F.col("doc_id").alias("doc_b")), "text_key").where("doc_a < doc_b")
    both = across.unionByName(within.select("doc_a", "doc_b")).where("doc_a <> doc_b")
    return both.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b")).distinct()


def shared_links(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """``(doc_id, class_id, copies, links)`` for every document with a text: the first document of equal text, how many there are, and with how many other
    documents it shares ``min_chars`` or more consecutive characters.

    Pairs are formed between classes of equal texts only; copies are counted, not expanded.
    """
    classes, texts = text_classes(docs)
    classes = cut(classes)
    sizes = classes.groupBy("text_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    pairs = cut(key_pairs(texts, min_chars))
    ends = pairs.select(F.col("key_a").alias("own"), F.col("key_b").alias("text_key")).unionByName(pairs.select(F.col("key_b").alias("own"), F.col("key_a").alias("text_key")))
    met = ends.join(sizes.select("text_key", "copies"), "text_key").groupBy(F.col("own").alias("text_key")).agg(F.sum("copies").alias("met"))
    long = docs.where(F.length("text") >= min_chars).select(F.md5("text").alias("text_key")).distinct()
    own = sizes.join(met, "text_key", "left").join(long.withColumn("long", F.lit(True)), "text_key", "left")
    links = F.when(F.col("long"), F.col("copies") - 1).otherwise(0) + F.coalesce("met", F.lit(0))
    return classes.join(own.select("text_key", "class_id", "copies", links.cast("bigint").alias("links")), "text_key").select("doc_id", "class_id", "copies", "links")


def shared_share(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, shared_share)`` for every document: how much of its text stands in runs of ``min_chars``
    or more characters found in another document too. Null or short texts have nothing shared (share null for empty texts).

    No pair is formed: a run counts as shared when its group spans two texts, and a text of several documents is shared as a whole. Runs of one text
    overlap; each covers what lies before the next one.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    classes, texts = text_classes(docs)
    runs = shared_runs(texts, min_chars)
    shared = runs.join(in_several(runs, "d1", "d2"), ["d1", "d2"], "left_semi").select(F.col("doc_id").alias("text_key"), "pos").distinct()
    gap = F.lead("pos").over(Window.partitionBy("text_key").orderBy("pos")) - F.col("pos")
    covered = shared.select("text_key", F.least(F.lit(min_chars), F.coalesce(gap, F.lit(min_chars))).alias("c")).groupBy("text_key").agg(F.sum("c").cast("bigint").alias("covered"))
    classes = cut(classes)
    copies = classes.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    known = classes.join(copies.join(covered, "text_key", "left"), "text_key").select("doc_id", "copies", "covered")
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    whole = (F.col("copies") > 1) & (F.col("n_chars") >= min_chars)
    shared_chars = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0).cast("bigint")))
    out = sizes.join(known, "doc_id", "left")
    return out.select("doc_id", "n_chars", shared_chars.alias("shared_chars"), F.try_divide(shared_chars, F.col("n_chars")).alias("shared_share"))
