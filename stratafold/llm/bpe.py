"""Byte-level byte-pair encoding and decoding.

A pre-token is encoded on a doubly linked list of symbols: a priority queue holds the merge rank and place of each neighbouring pair that
the vocabulary can merge; the lowest rank, leftmost first, is merged, and entries whose symbols have changed meanwhile are skipped when
they surface. Decoding concatenates vocabulary strings. Texts are cut into chunks at white space where pre-tokens cannot cross, and each
distinct chunk, and each short pre-token of it, is encoded once while it stays in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stratafold.llm.common import batch, sized, strings, texts, tokenizer_path

CACHED_CHUNKS = 300_000
CACHED_PIECE = 64

# The public pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A word with the space before it; a run of white space less its last character; a single white space.
_CHUNK = re.compile("( ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c])")
#: White space beyond ASCII, and the separators that only some engines count as such: such texts go through the pattern whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def merge(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply ``merges``, pairs of ids to (rank, merged id), to a list of ids: lowest rank first, then leftmost."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids = symbols[:]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(queue)
    while queue:
        _, i, left, right, made = heapq.heappop(queue)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue  # stale: one of the two has been merged
        ids[i], ids[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if m := merges.get((made, ids[k])):
                heapq.heappush(queue, (m[0], i, made, ids[k], m[1]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], made))):
            heapq.heappush(queue, (m[0], h, ids[h], made, m[1]))
    return [x for x in ids if x >= 0]


class ByteBPE:
    """A byte-level BPE vocabulary in the format of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.byte_ids = [vocab.get(letters[b], -1) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()], default=-1) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.decimal = [str(i).encode() for i in range(size)]
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pattern = regex.compile(PRE_TOKEN)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, list[int]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return self._pattern.findall(text)

    def encode_pre_token(self, piece: str) -> list[int]:
        return merge([self.byte_ids[b] for b in piece.encode()], self.merges)

    def _piece(self, piece: str) -> list[int]:
        """A pre-token's ids; those of words are kept, as they come with other neighbours in other chunks."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.encode_pre_token(piece)
            if len(piece) <= CACHED_PIECE:
                if len(self.pieces) >= CACHED_CHUNKS:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self._piece, self.pre_tokens(chunk))))
        self.known[chunk] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        chunks = self.pre_tokens(text) if _OTHER_SPACE.search(text) else _CHUNK.findall(text)
        known = self.known
        return list(chain.from_iterable([known.get(c) or self._chunk(c) for c in chunks]))

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text as (part, whether it is a special token)."""
        if not self._special or not self._special.search(text):
            return [(text, False)] if text else []
        return [(p, k % 2 == 1) for k, p in enumerate(self._special.split(text)) if p]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self.parts(text):
            if special:
                ids.append(self.special[part])
            else:
                ids += self._plain(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The vocabulary strings of ``ids`` in turn, special tokens included, as UTF-8."""
        strings = self.strings
        return b"".join([strings[i] for i in ids])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = ByteBPE(path)
    decimal = bpe.decimal
    for b in sized(batches, "text", 4 << 20):
        rows = []
        for doc, text in zip(b["doc_id"].to_pylist(), strings(b["text"]), strict=True):
            ids = bpe.encode(text)
            rows.append((doc, len(ids), hashlib.sha256(b",".join([decimal[i] for i in ids])).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        yield batch(dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)), _OUT)


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; null and empty texts have no ids and decode to nothing."""
    return texts(docs).mapInArrow(partial(_digests, path=tokenizer or tokenizer_path("byte_bpe_50k.json")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    bpe = ByteBPE(path)
    for b in sized(batches, "text", 4 << 20):
        yield batch({"doc_id": b["doc_id"], "ids": [bpe.encode(t) for t in strings(b["text"])]}, schema)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of ``docs``."""
    return texts(docs).mapInArrow(partial(_encode, path=tokenizer or tokenizer_path("byte_bpe_50k.json")), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    bpe = ByteBPE(path)
    for b in batches:
        yield batch({"doc_id": b["doc_id"], "text": [bpe.decode(x or []).decode("utf-8", "replace") for x in b["ids"].to_pylist()]}, schema)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; bytes that are not UTF-8 become replacement characters, null ids the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=tokenizer or tokenizer_path("byte_bpe_50k.json")), "doc_id long, text string")
