"""Token counts that follow edits.

A text is cut into units, white-space bounded runs of pre-tokens, which byte-pair encoding never joins, so its count is the sum of theirs. Units stand in the
leaves of a segment tree, some dozens a leaf, whose nodes hold the characters and tokens of their subtrees; the text is nowhere else. An edit finds its place by a walk down,
re-reads the units that it touches, with two characters of context before it, and goes on behind it only until a new unit begins where an old one did: from there the
pattern, which looks ahead but never back, must repeat itself. Only new units are encoded, and the sums change on the paths to the root alone: an edit's cost follows
its own length and the depth of the tree, not the text.

Texts with white space beyond ASCII or special tokens have single pre-tokens as units, and an edit to or from such a text counts it anew.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache, partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratafold.llm.bpe import _CHUNK, _OTHER_SPACE, PRE_TOKEN, ByteBPE, byte_letters
from stratafold.llm.common import batch, sized, strings, texts, tokenizer_path

LEAF = 48  # units in a new leaf
CONTEXT = 2  # characters that the pattern looks at beyond a unit
CACHED_UNITS = 400_000


_PLAIN_WORD = re.compile(" ?[^\\s\x1c-\x1f\x85]+")


@cache
def _ranks(path: str) -> tuple[Any, int]:
    """The vocabulary as merge ranks of byte strings, and the rank of a line end."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    back = {c: bytes([b]) for b, c in byte_letters().items()}
    ranks = {bytes([b]): b for b in range(256)}
    for k, m in enumerate(merges):
        ranks.setdefault(b"".join(back[c] for c in (m.replace(" ", "") if isinstance(m, str) else "".join(m))), 256 + k)
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]


class Counter(dict):
    """Token counts of units, kept for the last units seen. Distinct new words are encoded together by their merge ranks."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.longest = bpe, max(map(len, bpe.special), default=1)
        self.ranks, self.newline = _ranks(bpe.path)

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Words, with a space before them or none, are encoded in one text, a line each, which pre-tokens do not cross; other units go through the queue of ``bpe``."""
        if len(self) > CACHED_UNITS:
            self.clear()
        fresh = list({u for units in texts for u in units if u not in self})
        words = [u for u in fresh if _PLAIN_WORD.fullmatch(u) and u not in self.bpe.special]
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.ranks.encode_ordinary("\n".join(["", *part, ""])))
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) != len(part) + 1:
                raise ValueError("a unit holds a line end")
            self.update(zip(part, (np.diff(cuts) - 1).tolist(), strict=True))
        self.bpe.known.clear()
        for u in fresh:
            if u not in self:
                self[u] = len(self.bpe.encode(u))

    def counts(self, units: list[str]) -> list[int]:
        try:
            return list(map(self.__getitem__, units))
        except KeyError:
            self.learn([units])
            return list(map(self.__getitem__, units))

    def plain(self, text: str) -> bool:
        return not (_OTHER_SPACE.search(text) or any(t in text for t in self.bpe.special))

    def units(self, text: str) -> list[str]:
        if self.plain(text):
            return _CHUNK.findall(text)
        return [u for part, special in self.bpe.parts(text) for u in ([part] if special else self.bpe.pre_tokens(part))]


class CountedText:
    """A text with its token count; ``edit`` keeps both. The text exists as its units alone, some dozens a leaf."""

    def __init__(self, text: str, counter: Counter, units: list[str] | None = None):
        self.counter = counter
        self._build(text, units)

    def _build(self, text: str, units: list[str] | None = None) -> int:
        self.plain = self.counter.plain(text)
        units = self.counter.units(text) if units is None else units
        counts = self.counter.counts(units)
        self._plant([units[k : k + LEAF] for k in range(0, len(units), LEAF)] or [[]], [counts[k : k + LEAF] for k in range(0, len(units), LEAF)] or [[]])
        return len(units)

    def _plant(self, units: list[list[str]], counts: list[list[int]]) -> None:
        """The tree over leaves of units: characters and tokens of each subtree."""
        self.units, self.counts = units, counts
        self.base = 1 << (len(units) - 1).bit_length()
        pad = [0] * (self.base - len(units))
        self.chars = [0] * self.base + [sum(map(len, x)) for x in units] + pad
        self.sums = [0] * self.base + list(map(sum, counts)) + pad
        for k in range(self.base - 1, 0, -1):
            self.chars[k], self.sums[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.sums[2 * k] + self.sums[2 * k + 1]

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(u for leaf in self.units for u in leaf)

    @property
    def lengths(self) -> list[list[int]]:
        return [list(map(len, leaf)) for leaf in self.units]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def prefix_tokens(self, position: int) -> int:
        """Tokens of the units that end at ``position`` or before."""
        leaf, at, before = self._leaf(position)
        for u, c in zip(self.units[leaf], self.counts[leaf], strict=True):
            if at + len(u) > position:
                break
            at, before = at + len(u), before + c
        return before

    def _leaf(self, position: int) -> tuple[int, int, int]:
        """The first leaf that ends behind ``position``, or the last; the characters and tokens before it."""
        k, at, tokens = 1, 0, 0
        while k < self.base:
            k *= 2
            if at + self.chars[k] <= position and self.chars[k + 1]:
                at, tokens, k = at + self.chars[k], tokens + self.sums[k], k + 1
        return min(k - self.base, len(self.units) - 1), at, tokens

    def slice(self, start: int, end: int) -> str:
        """The characters from ``start`` to before ``end``, from the leaves that hold them."""
        leaf, at, _ = self._leaf(max(start, 0))
        parts, first = [], at
        while leaf < len(self.units) and at < end:
            parts.append("".join(self.units[leaf]))
            at, leaf = at + len(parts[-1]), leaf + 1
        return "".join(parts)[max(start, 0) - first : max(end - first, 0)]

    def _update(self, leaf: int) -> None:
        k = leaf + self.base
        self.chars[k], self.sums[k] = sum(map(len, self.units[leaf])), sum(self.counts[leaf])
        while k := k // 2:
            self.chars[k], self.sums[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.sums[2 * k] + self.sums[2 * k + 1]

    def _stays_plain(self, start: int, end: int, replacement: str) -> bool:
        """Only the replacement can bring new white space, and only it with its surroundings a special token."""
        if not self.plain or _OTHER_SPACE.search(replacement):
            return False
        near = self.counter.longest - 1
        return self.counter.plain(self.slice(start - near, start) + replacement + self.slice(end, end + near))

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replace the characters from ``start`` to before ``end``; returns how many units were encoded again."""
        start = min(max(start, 0), len(self))
        end = min(max(end, start), len(self))
        if not self._stays_plain(start, end, replacement):
            return self._build(self.slice(0, start) + replacement + self.slice(end, len(self)))
        shift = len(replacement) - (end - start)
        leaf, at, _ = self._leaf(max(0, start - CONTEXT))
        unit = 0
        while unit < len(self.units[leaf]) and at + len(self.units[leaf][unit]) <= start - CONTEXT:
            at, unit = at + len(self.units[leaf][unit]), unit + 1
        reach = 2 * CONTEXT + 64
        while True:  # a window behind the edit, doubled until units begin in it where old ones did
            last = end + reach >= len(self)
            window = self.slice(at, start) + replacement + self.slice(end, min(end + reach, len(self)))
            found = self._resume(window, at, leaf, unit, start + len(replacement), end, shift, last)
            if found:
                break
            reach *= 2
        made, to_leaf, to_unit = found
        for table, new in ((self.units, made), (self.counts, self.counter.counts(made))):
            tail = table[to_leaf][to_unit:]
            for k in range(leaf + 1, to_leaf + 1):
                table[k] = []
            table[leaf] = table[leaf][:unit] + new + (tail if to_leaf == leaf else [])
            if to_leaf > leaf:
                table[to_leaf] = tail
        if len(self.units[leaf]) > 8 * LEAF:  # a leaf that has grown is cut; only sums are made anew
            cut = lambda table: [p for x in table for p in ([x[k : k + LEAF] for k in range(0, len(x), LEAF)] if len(x) > 8 * LEAF else [x])]
            self._plant(cut(self.units), cut(self.counts))
        else:
            for k in range(leaf, to_leaf + 1):
                self._update(k)
        return len(made)

    def _resume(self, window: str, at: int, leaf: int, unit: int, new_end: int, old_end: int, shift: int, last: bool) -> tuple[list[str], int, int] | None:
        """New units of ``window``, which begins at ``at``, up to where one begins behind the edit at an old unit's place, and that place; None if the window is too short."""
        old, new, units, fresh = at, at, [], _CHUNK.finditer(window)
        while new < new_end or old < old_end or new - shift != old:
            if new < new_end or new - shift < old:
                m = next(fresh, None)
                if m is None or (m.end() == len(window) and not last):  # what follows the window could change this unit
                    return None
                units.append(m.group())
                new += len(units[-1])
            else:
                while unit >= len(self.units[leaf]):
                    leaf, unit = leaf + 1, 0
                old, unit = old + len(self.units[leaf][unit]), unit + 1
        return units, leaf, unit


#: Edits of the query: place as a share of the text, characters to delete, text to insert.
EDITS = ((1 / 3, 5, " an inserted passage, "), (2 / 3, 40, ""), (1 / 2, 0, "\n\n"), (1.0, 0, " The end."))

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("edited_tokens", pa.int64()), ("reencoded_units", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch], path: str, edits: tuple) -> Iterator[pa.RecordBatch]:
    counter = Counter(ByteBPE(path))
    for b in sized(batches, "text", 4 << 20):
        rows, whole = [], strings(b["text"])
        units = list(map(counter.units, whole))
        counter.learn(units)
        for doc, text, own in zip(b["doc_id"].to_pylist(), whole, units, strict=True):
            counted = CountedText(text, counter, own)
            before, again = counted.tokens, 0
            for share, gone, come in edits:
                at = int(len(counted) * share)
                again += counted.edit(at, at + gone, come)
            rows.append((doc, before, counted.tokens, again))
        yield batch(dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)), _OUT)


def edited_counts(docs: DataFrame, tokenizer: str | None = None, edits: tuple = EDITS) -> DataFrame:
    """(doc_id, n_tokens, edited_tokens, reencoded_units) of each row: counts before and after ``edits`` in turn, and the units encoded for them.

    Null and empty texts have no tokens before the edits.
    """
    return texts(docs).mapInArrow(partial(_count, path=tokenizer or tokenizer_path("byte_bpe_50k.json"), edits=edits), "doc_id long, n_tokens long, edited_tokens long, reencoded_units long")
