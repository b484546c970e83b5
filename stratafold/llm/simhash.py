"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints are sorted by their rank in the reflected Gray code, where neighbours share long bit
patterns. The index is a tree over that order: a node holds the bits on which everything under it
agrees, less the bits that its ancestors already fixed, so that a walk down adds up the differing bits
of each node once and drops a whole group as soon as the sum passes the limit.

On a cluster the tree's upper levels are the shards: equal runs of the Gray order, at most ``MAX_SHARDS``
of them, whose patterns every task holds. A fingerprint goes only to the later shards that the upper
levels cannot rule out; the lower levels are built inside the shard. Shards are cut at quantiles, so a dense
group of near copies is spread over several. A shard returns a spanning forest of its links, not the pairs.

The pipeline's stage, ``keep_one``, proposes pairs by this index and, since pairs of likeness 0.8 lie farther apart than any index of 64-bit codes can search without comparing
nearly all, by the MinHash bands of ``neardup``; both kinds are decided by exact likeness.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import neardup
from stratafold.llm.common import batch, settle, sized, texts, utf8
from stratafold.llm.components import FEW_LINKS, connected_components, forest

SHINGLE = 3
MAX_BITS = 2
FAN = 16
SHARD_ROWS = 2048
MAX_SHARDS = 4096
MAX_FRONT = 1 << 21
TASK_ROWS = 1 << 22

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text: the majority of its shingles' bits, zero without words."""
    words = text.lower().split()  # on bytes both are ASCII only
    if not words:
        return 0
    chains = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(chains), 1 << 16):
        h = np.fromiter(map(_hash, chains[at : at + (1 << 16)]), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(chains), bitorder="little").view(np.uint64)[0])


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for b in sized(batches, "text"):
        fps = np.array([simhash(x, shingle) for x in utf8(b["text"])], np.uint64)
        yield batch({"doc_id": b["doc_id"], "fp": fps.view(np.int64)}, schema)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return texts(docs).mapInArrow(partial(_fingerprint, shingle=shingle), "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """A tree over patterns in Gray order; ``masks`` says which bits of a pattern are fixed (all, for fingerprints)."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, fan: int = FAN):
        masks = np.full(len(patterns), ~np.uint64(0)) if masks is None else masks
        self.fan, self.levels = fan, []
        while True:
            if len(patterns) <= fan:
                self.levels.append((patterns, masks))
                break
            starts = np.arange(0, len(patterns), fan)
            first = np.repeat(patterns[starts], fan)[: len(patterns)]
            up = np.bitwise_and.reduceat(masks, starts) & ~np.bitwise_or.reduceat(patterns ^ first, starts)
            self.levels.append((patterns, masks & ~np.repeat(up, fan)[: len(patterns)]))
            patterns, masks = patterns[starts] & up, up
        self.levels.reverse()

    def search(self, queries: np.ndarray, most: int, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query position, leaf position) whose fixed bits differ in ``most`` places at most."""
        for at in range(0, len(queries), rows):
            yield from self._walk(at, queries[at : at + rows], most)

    def _walk(self, at: int, q: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Level by level for all queries at once; a front that grows past ``MAX_FRONT`` is walked in halves."""
        top = len(self.levels[0][0])
        who, node, spent = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q)), np.uint8(0)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                if len(who) * self.fan > MAX_FRONT and len(q) > 1:
                    yield from self._walk(at, q[: len(q) // 2], most)
                    yield from self._walk(at + len(q) // 2, q[len(q) // 2 :], most)
                    return
                who, spent = np.repeat(who, self.fan), np.repeat(spent, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                if node.size and node.max() >= len(pattern):
                    inside = np.flatnonzero(node < len(pattern))
                    who, spent, node = who[inside], spent[inside], node[inside]
            spent = spent + np.bitwise_count((q[who] ^ pattern[node]) & mask[node])
            near = np.flatnonzero(spent <= most)
            who, node, spent = who[near], node[near], spent[near]
        yield who + at, node


def _route(batches: Iterator[pa.RecordBatch], cuts: np.ndarray, patterns: np.ndarray, masks: np.ndarray, parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint to all parts of its own shard as a member, and as a query to a part of each shard that may hold links."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("member", pa.bool_()), ("fp", pa.int64())])
    tree = GrayIndex(patterns, masks)
    for b in batches:
        fps = b["fp"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        own = np.searchsorted(cuts, gray_rank(fps), side="right")
        part = (fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts
        yield batch({"shard": np.repeat(own, parts), "part": np.tile(np.arange(parts), len(fps)), "member": np.ones(len(fps) * parts, bool), "fp": np.repeat(fps, parts).view(np.int64)}, schema)
        for who, shard in tree.search(fps, most):
            later = np.flatnonzero(shard > own[who])
            who, shard = who[later], shard[later]
            yield batch({"shard": shard, "part": part[who], "member": np.zeros(len(who), bool), "fp": fps[who].view(np.int64)}, schema)


def _link(table: pa.Table, parts: int, most: int) -> pa.Table:
    """Spanning links of one part of a shard: its queries, and its own share of the members, against the members."""
    fps, member = table["fp"].to_numpy().view(np.uint64), table["member"].to_numpy(zero_copy_only=False)
    part = table["part"][0].as_py()
    inside = fps[member]
    inside = inside[np.argsort(gray_rank(inside), kind="stable")]
    n = len(inside)
    mine = np.flatnonzero((inside * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts == part)
    codes = np.concatenate([inside, fps[~member]])
    asks = np.concatenate([mine, np.arange(n, len(codes))])
    tree = GrayIndex(inside)
    root = forest(len(codes), ((asks[who], leaf) for who, leaf in tree.search(codes[asks], most)))
    apart = np.flatnonzero(root != np.arange(len(codes)))
    return pa.table({"a": codes[apart].view(np.int64), "b": codes[root[apart]].view(np.int64)})


def links(distinct: DataFrame, most: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): a spanning set of the links among the distinct fingerprints ``distinct.fp``, which is read three times."""
    n = distinct.count()
    shards = min(MAX_SHARDS, max(1, -(-n // shard_rows)))
    bits = shards.bit_length()
    parts = -(-n // shards * (2 + bits + bits * bits // 2) // TASK_ROWS)  # the upper levels let a query into about so many shards
    parts = max(1, parts)
    ranked = distinct.select("fp").mapInArrow(_ranks, "fp long, rank long")
    cuts = ranked.agg(F.percentile_approx("rank", [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0] if shards > 1 and n else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    bounds = distinct.select("fp").mapInArrow(partial(_shards, cuts=cuts), "shard int, fp long").groupBy("shard").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high")).collect()
    low, high = np.zeros(len(cuts) + 1, np.int64), np.full(len(cuts) + 1, -1, np.int64)
    for r in bounds:
        low[r["shard"]], high[r["shard"]] = r["low"], r["high"]
    masks = ~(low ^ high).view(np.uint64)
    unsigned = (cuts ^ np.int64(-(1 << 63))).view(np.uint64)
    routed = distinct.select("fp").mapInArrow(partial(_route, cuts=unsigned, patterns=low.view(np.uint64) & masks, masks=masks, parts=parts, most=most), "shard int, part int, member boolean, fp long")
    return routed.groupBy("shard", "part").applyInArrow(lambda rows: _link(rows, parts, most), "a long, b long")


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Gray rank as a signed long of the same order."""
    schema = pa.schema([("fp", pa.int64()), ("rank", pa.int64())])
    for b in batches:
        fps = b["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
        yield batch({"fp": fps, "rank": gray_rank(fps.view(np.uint64)).view(np.int64) ^ np.int64(-(1 << 63))}, schema)


def _shards(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int32()), ("fp", pa.int64())])
    for b in batches:
        fps = b["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
        yield batch({"shard": np.searchsorted(cuts, gray_rank(fps.view(np.uint64)).view(np.int64) ^ np.int64(-(1 << 63)), side="right"), "fp": fps}, schema)


def near_duplicates(docs: DataFrame, most: int = MAX_BITS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    Fingerprints that differ in ``most`` bits or fewer are linked; the component id is the smallest doc_id that
    links reach, itself included. Texts without words have fingerprint zero and link like any other. A row without a
    doc_id links, but names no component; a component of such rows alone has a null id. Repeated rows share one.
    """
    marked = settle(fingerprints(docs, shingle), "fingerprints")
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    near = settle(links(distinct, most, shard_rows), "near")
    # few links have few components: they go to every task, and no large component is gathered in one
    held = F.broadcast if near.count() <= FEW_LINKS else lambda df: df
    roots = held(connected_components(near))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    least = joined.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = joined.join(held(least), "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, likeness: float = neardup.LIKENESS, most: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group that pairs of ``likeness`` or more link: the smallest doc_id's, and of its rows the first by text.

    Likeness is the Jaccard share of five-word shingles and is decided exactly. The index proposes the texts whose fingerprints over these shingles differ in
    ``most`` bits or fewer. Of pairs at 0.8 most are farther apart, 10 of 64 bits on average, where no prefix of a code holds them together; the bands of
    ``neardup`` propose those. Groups are of rows: other texts under a repeated id stay, and rows without a doc_id are copies like any, after those with one.
    Null and empty texts, and texts without words, are copies of each other; an empty table stays empty; columns pass through whatever their names.
    """
    marked = settle(neardup.mark(docs), "near-marked")
    codes = settle(marked.filter(F.col("__bands").isNotNull()).groupBy(F.col("__fp").alias("fp")).agg(F.min("__copy").alias("copy")), "near-codes")
    close = links(codes, most)
    first, second = (codes.withColumnsRenamed({"fp": c, "copy": f"copy_{c}"}) for c in "ab")
    pairs = close.join(first, "a").join(second, "b").select(F.col("copy_a").alias("a"), F.col("copy_b").alias("b"))
    return neardup.first_of_groups(docs, marked, neardup.groups(marked, pairs, likeness))
