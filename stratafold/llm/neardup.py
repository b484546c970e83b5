"""Part of the near-dedup by SimHash (``simhash.keep_one``): exact likeness of proposed pairs, and MinHash bands that propose the pairs which fingerprints keep apart.

A text is the set of its ``SHINGLE``-word chains. Texts of equal sets are copies and go on as one. ``BANDS`` bands of ``ROWS`` minima propose pairs:
of pairs with likeness 0.8 a share of (1 - 0.8^6)^32 = 6e-5 is not proposed. A bucket first compares each text with its head, so a group of near
copies costs its size and not its square. Texts of a bucket that are still apart meet through their rarest chains (prefix filter): two sets with likeness t share
one of the first n - ceil(t n) + 1 chains of each in any common order. The order puts chains first that occur in one group alone, where they meet nothing, then
rare ones; a passage that many unlike texts share comes last, and the rest of both texts after their first shared chain must suffice, so its group is not paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.llm.common import batch, settle, sized, utf8
from stratafold.llm.components import connected_components
from stratafold.llm.members import possible, without

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 32, 6
SEED = 11

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word chains of a UTF-8 text; a shorter text is one chain."""
    words = text.lower().split()  # on bytes both are ASCII only
    chains = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(_hash, chains), np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of minima of a set of hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 256):
        np.minimum(least, ((found[at : at + 256] ^ _FLIP) * _TIMES).min(1), out=least)
    raw, step = least.tobytes(), ROWS * 8
    return [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], seed=k) for k in range(BANDS)]


def majority(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view(np.uint64)[0])


def _mark(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows with the digest of their set; fingerprint and bands go with the first row of a digest in a batch."""
    for b in sized(batches, text):
        copy, codes, keys, seen = [], [], [], set()
        for x in utf8(b[text].cast(pa.string())):
            found = shingles(x)
            copy.append(xxhash.xxh64_intdigest(found.tobytes()))
            fresh = copy[-1] not in seen
            codes.append(majority(found) if fresh else 0)
            keys.append(np.array(bands(found), np.uint64).view(np.int64) if fresh else None)
            seen.add(copy[-1])
        signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        fields = [*b.schema, pa.field("__copy", pa.int64()), pa.field("__fp", pa.int64()), pa.field("__bands", pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns, signed(copy), signed(codes), pa.array(keys, pa.list_(pa.int64()))], schema=pa.schema(fields))


def mark(docs: DataFrame) -> DataFrame:
    """``docs`` with __copy, the digest of a row's shingles, __fp and __bands, null bands where an equal row of the batch has them, and __row, a number of the row."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__copy", T.LongType()), T.StructField("__fp", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(partial(_mark, text="text"), schema).withColumn("__row", F.monotonically_increasing_id())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("copy", pa.int64()), ("found", pa.binary())])
    for b in sized(batches, "text", 2 << 20):
        yield batch({"copy": b["copy"], "found": [shingles(x).tobytes() for x in utf8(b["text"])]}, schema)


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for rows in batches:
        keep = []
        for x, y in zip(rows["x"], rows["y"], strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared >= least * (len(x) + len(y) - shared))
        yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).cast(schema)


def groups(marked: DataFrame, close: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(node, root): the copies of ``marked`` that pairs of ``likeness`` or more link; ``close`` (a, b) are pairs to try beside those of the bands."""
    known = marked.filter("__bands is not null")
    firsts = known.groupBy("__copy").agg(F.count("*").alias("n"), F.min("__row").alias("first")).filter("n > 1")
    again = settle(known.select("__row", "__copy").join(firsts, "__copy").filter("__row <> first").select("__row"), "near-again")
    keys = F.concat("__bands", F.array(F.xxhash64(F.lit("fingerprint"), "__fp")))  # equal fingerprints are a bucket as well
    keyed = without(known.select("__row", "__copy", "__fp", "__bands"), again, "__row").select(F.col("__copy").alias("copy"), F.explode(keys).alias("key"))
    sizes = settle(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "near-sizes")
    met = settle(possible(keyed, sizes, "key").join(sizes, "key"), "near-buckets")  # most keys are of one text and are not moved again
    # the head of a bucket is its text with the most company: edited copies are nearer to their original than to each other
    company = met.groupBy("copy").agg(F.sum("size").alias("company"))
    heads = met.join(company, "copy").groupBy("key").agg(F.max(F.struct("company", "copy"))["copy"].alias("head"))
    shared = met.select("key", "copy").join(heads, "key")
    close = settle(close, "near-close")
    asked = settle(shared.select(F.col("copy").alias("__copy")).unionByName(close.select(F.explode(F.array("a", "b")).alias("__copy"))).distinct(), "near-asked")
    # one text of each copy: bands are known in few of its rows, which keeps the rest out of the shuffle
    chosen = possible(known.select("__copy", "text"), asked, "__copy").join(asked, "__copy", "left_semi").select(F.col("__copy").alias("copy"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["copy"])
    sets = settle(chosen.mapInArrow(_sets, "copy long, found binary"), "near-sets")

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        # likeness needs sizes as near; sizes go first, so that only sets that may be alike are moved
        sizes = sets.select("copy", F.length("found").alias("n"))
        near = pairs.join(sizes.withColumnsRenamed({"copy": "a", "n": "m"}), "a").join(sizes.withColumnRenamed("copy", "b"), "b").filter(F.least("m", "n") >= F.greatest("m", "n") * likeness).select("a", "b")
        near = settle(near, f"{name}-sizes")
        whole = near.join(possible(sets.withColumnsRenamed({"copy": "a", "found": "x"}), near, "a"), "a").join(possible(sets.withColumnsRenamed({"copy": "b", "found": "y"}), near, "b"), "b")
        return settle(whole.select("a", "b", "x", "y").mapInArrow(partial(_alike, least=likeness), "a long, b long"), name)

    first = alike(shared.filter("copy <> head").select(F.least("head", "copy").alias("a"), F.greatest("head", "copy").alias("b")).unionByName(close.select("a", "b")).distinct(), "near-first")
    roots = connected_components(first)
    named = shared.join(roots.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    return connected_components(first.unionByName(alike(apart(named.filter("copy <> head"), sets, likeness), "near-second")))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("copy", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("chain", pa.int64())])
    for b in sized(batches, "found", 2 << 20):
        found = [np.frombuffer(x, np.int64) for x in b["found"].to_pylist()]
        n = np.array([len(x) for x in found])
        copy, root = (np.repeat(b[c].to_numpy(), n) for c in ("copy", "root"))
        yield batch({"copy": copy, "root": root, "n": np.repeat(n, n), "chain": np.concatenate(found)}, schema)


def apart(named: DataFrame, sets: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(a, b): texts of ``named`` (key, copy, root) in buckets of several roots, of different roots themselves, that may have ``likeness``; ``sets`` (copy, found).

    All such pairs of those texts with ``likeness`` are among them, in a shared bucket or not.
    """
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    open_ = settle(named.join(mixed, "key", "left_semi").select("copy", "root").distinct(), "near-open")
    chains = possible(sets, open_, "copy").join(open_, "copy").mapInArrow(_chains, "copy long, root long, n long, chain long")
    # chains of one root meet nothing: they count as the first of a text's order and go no further
    common = chains.groupBy("chain").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("chain", "c")
    own = Window.partitionBy("copy")
    ranked = chains.join(common, "chain").withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "chain")))
    prefix = settle(ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * likeness - 1e-9) + 1).select("chain", "copy", "root", "n", "at"), "near-prefixes")
    left, right = (prefix.select("chain", F.col("copy").alias(c), F.col("root").alias(f"root_{c}"), F.col("n").alias(f"n_{c}"), (F.col("n") - F.col("at") + 1).alias(f"rest_{c}")) for c in "ab")
    # at the first chain that two texts share, what they share is at most the rest of either
    enough = F.least("rest_a", "rest_b") >= (F.col("n_a") + F.col("n_b")) * (likeness / (1 + likeness)) - 1e-9
    met = left.join(right, "chain").filter(F.expr("a < b and root_a <> root_b") & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * likeness - 1e-9) & enough)
    return met.select("a", "b").distinct()


def first_of_groups(docs: DataFrame, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of each group: the smallest doc_id's, rows without one last, and of its rows the first by text.

    Groups are made of row numbers; texts are moved of the rows that go, and of those that share the smallest doc_id of a group.
    """
    rows = marked.select("__row", "__copy", "doc_id").join(roots.withColumnsRenamed({"node": "__copy", "root": "__root"}), "__copy", "left")
    rows = settle(rows.select("__row", F.coalesce("__root", "__copy").alias("__group"), "doc_id"), "near-rows")
    least = rows.groupBy("__group").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id"))["doc_id"].alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = settle(rows.join(least, "__group").select("__row", "__group", F.col("doc_id").eqNullSafe(F.col("least")).alias("first")), "near-several")
    tied = several.filter("first").groupBy("__group").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    tied = settle(several.filter("first").join(tied, "__group", "left_semi").select("__row", "__group"), "near-tied")
    ranked = possible(marked.select("__row", "text"), tied, "__row").join(tied, "__row").withColumn("__rank", F.row_number().over(Window.partitionBy("__group").orderBy("text")))
    kept = ranked.filter("__rank = 1").select("__row")
    gone = several.filter("not first").select("__row").unionByName(tied.join(kept, "__row", "left_anti").select("__row"))
    return without(marked, settle(gone, "near-gone"), "__row").select(*docs.columns)
