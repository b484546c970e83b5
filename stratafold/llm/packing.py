"""Best-fit decreasing packing of token pieces into sequences.

Best-fit decreasing sees a bin only through its remaining capacity, so bins of equal remainder are one class, and items
are only lengths. The plan is therefore made from the histogram of lengths (``capacity`` counts at most): lengths in
falling order, a segment tree over remaining capacities gives the tightest open class in logarithmic time, and all its
bins are filled at once as the same rule would fill them one by one. The plan is a list of runs: ranks of one length that go to
consecutive bins at one offset. Its size depends on the capacity, not on the corpus. Pieces get their rank in their length
from windows over (length, salt), where frequent lengths have several salts, and look up their run.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.bpe import byte_letters
from stratafold.llm.common import batch, settle, sized, texts, tokenizer_path, utf8

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 300_000
#: Latin letters that lower-casing and composition treat one by one, then ASCII punctuation without the apostrophe of contractions.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of white-space separated words as little-endian uint32 bytes, by a tokenizer that never joins across white space.

    A text's ids are then its words' ids in turn, so each word is encoded once while it stays in the bounded cache. Words of Latin
    letters, with punctuation after them, are lower-cased and merged in bulk by the vocabulary's ranks; the library encodes all others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self._rank(path)

    def _rank(self, path: str) -> None:
        """The merges as ranks of byte strings, where a zero byte ends a word; it joins its letter before all else."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, end = byte_letters(), model["end_of_word_suffix"]
        back = {c: b for b, c in letters.items()}
        text = lambda token: bytes(back[c] for c in token.removesuffix(end)) + b"\0" * token.endswith(end)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [*letters.values(), *(c + end for b, c in letters.items() if b), *(a + b for a, b in pairs)]
        ranks = {bytes([b]): b for b in range(256)}
        self.table = np.zeros(len(tokens), "<u4")
        for k, token in enumerate([letters[b] for b in range(256)] + tokens[256:]):
            ranks.setdefault(text(token), k)
            self.table[k] = model["vocab"].get(token, 0)
        self.ends = np.array([x.endswith(end) for x in tokens])
        self.ranks = tiktoken.Encoding("ranks", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _letters(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            got = np.array(self.ranks.encode_ordinary("\0".join(part) + "\0"))
            ids, first = self.table[got].tobytes(), 0
            for piece, last in zip(part, ((np.flatnonzero(self.ends[got]) + 1) * 4).tolist(), strict=True):
                self.pieces[piece] = ids[first:last]
                first = last

    def _library(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 4096):
            for e in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def _learn(self, fresh: set[bytes]) -> None:
        """Flat lists of strings only: tuples by the hundred thousand would set off the garbage collector."""
        pieces, match = self.pieces, _LETTERS.fullmatch
        words, letters, marks, rest = [], [], [], []
        for w in fresh:
            if m := match(w.decode()):
                words.append(w)
                a, b = m.groups()
                letters.append(a.lower())
                marks.append(b)
            else:
                rest.append(w)
        self._letters(list(set(letters).difference(pieces)))
        fresh_marks = list(set(marks).difference(pieces))
        pieces.update(zip(fresh_marks, self._library(fresh_marks), strict=True))
        for w, a, b in zip(words, letters, marks, strict=True):
            self.known[w] = pieces[a] + pieces[b]
        self.known.update(zip(rest, self._library([w.decode() for w in rest]), strict=True))

    def texts(self, rows: list[bytes]) -> Iterator[bytes]:
        words = [x.split() for x in rows]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if len(self.pieces) > CACHED_WORDS:
            self.pieces = {"": b""}
        known = self.known
        fresh: set[bytes] = set()
        for x in words:
            fresh.update(set(x).difference(known))
        self._learn(fresh)
        for x in words:
            yield b"".join([known[w] for w in x])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: bytes) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    ids = WordIds(path)
    for b in sized(batches, "text", 4 << 20):
        rows = []
        for doc, buffer in zip(b["doc_id"].to_pylist(), ids.texts(utf8(b["text"])), strict=True):
            buffer += end
            for k, at in enumerate(range(0, len(buffer), 4 * capacity)):
                piece = buffer[at : at + 4 * capacity]
                rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
        yield batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut only where longer than ``capacity``."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    return texts(docs).mapInArrow(partial(_pieces, path=path, capacity=capacity, end=np.array([end_id], "<u4").tobytes()), "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Runs of open bins by remaining capacity, under a segment tree that counts the classes in use."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.leaves)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.used[at] += by
            at >>= 1

    def put(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            if not self.runs[room]:
                self._count(room, 1)
            self.runs[room].appendleft((first, bins))

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].popleft()
        if not self.runs[room]:
            self._count(room, -1)
        return run

    def tightest(self, need: int) -> int | None:
        """The smallest room in use that is ``need`` or more."""
        at = need + self.leaves
        while not self.used[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of a level
                return None
        while at < self.leaves:
            at = 2 * at + (not self.used[2 * at])
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, items a bin, offset) of best-fit decreasing over ``counts`` of lengths."""
    open_bins, runs, bins = OpenBins(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, each: int, n: int, room: int, length=length) -> None:
            nonlocal rank, left
            if n and each:
                runs.append((length, rank, first, each, capacity - room))
                open_bins.put(room - each * length, first, n)
                rank, left = rank + each * n, left - each * n

        while left:
            room = open_bins.tightest(length)
            if room is None:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins.take(room)
            each = room // length
            full = min(n, left // each)
            fill(first, each, full, room)
            rest = n - full
            if rest and left and left < each:
                fill(first + full, left, 1, room)
                full, rest = full + 1, rest - 1
            if room < capacity:
                open_bins.put(room, first + full, rest)
    return runs


def _place(batches: Iterator[pa.RecordBatch], runs: np.ndarray, bases: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    keys = (runs[:, 0] << 44) + runs[:, 1]
    for b in batches:
        length = b["length"].to_numpy()
        base = np.array([bases[k] for k in zip(length.tolist(), b["salt"].to_pylist(), strict=True)], np.int64)
        rank = base + b["rn"].to_numpy() - 1
        _, first, bin_, each, offset = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1].T
        k = rank - first
        yield pa.RecordBatch.from_arrays([b[n] for n in schema.names[:5]] + [pa.array(bin_ + k // each), pa.array(offset + k % each * length)], schema=schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Equal lengths are dealt in the order of doc_id and piece; repeated rows are
    packed once each. A text without white space or of any length is encoded whole.
    """
    made = settle(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, sum(counts.values()) // (2 * parts))  # so many pieces of one length in a window
    salts = {n: -(-c // most) for n, c in counts.items() if c > most}
    salt = F.coalesce(F.create_map([F.lit(x) for pair in salts.items() for x in pair])[F.col("length")], F.lit(1)) if salts else F.lit(1)
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salt.cast("long")))
    bases, before = {}, {}
    for r in sorted(salted.groupBy("length", "salt").count().collect()):  # a row per length and 2 * parts more at most
        bases[r["length"], r["salt"]] = before.get(r["length"], 0)
        before[r["length"]] = before.get(r["length"], 0) + r["count"]
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    return ranked.mapInArrow(partial(_place, runs=runs, bases=bases), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
