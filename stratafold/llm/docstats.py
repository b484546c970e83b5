"""Counts over the bytes and words of a text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Byte classes. Bytes of 128 and above are parts of letters beyond ASCII.
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "symbol": b"#*$%&<>|",
    "pipe": b"|",
    "bang": b"!",
    "stop": b".,;:?",
    "letter": bytes(chain(range(65, 91), range(97, 123), range(128, 256))),
}
CLASSES = list(_CLASSES)


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(members)] = 1
    return t


_TABLES = {k: _table(v) for k, v in _CLASSES.items()}


def class_counts(text: bytes, starts: np.ndarray | None = None) -> np.ndarray:
    """Counts of each class (columns) in the segments that begin at ``starts`` (rows; one for the whole text)."""
    a = np.frombuffer(text, np.uint8)
    starts = np.zeros(1, np.int64) if starts is None else starts
    if not len(a):
        return np.zeros((len(starts), len(CLASSES)))
    if len(starts) == 1:
        n = np.bincount(a, minlength=256)
        return np.array([[n[t.view(bool)].sum() for t in _TABLES.values()]], float)
    # a segment of no bytes would repeat its neighbour's first byte
    ends = np.append(starts[1:], len(a))
    out = np.stack([np.add.reduceat(t[a], np.minimum(starts, len(a) - 1), dtype=np.int64) for t in _TABLES.values()], axis=1).astype(float)
    out[starts >= ends] = 0
    return out


NAMES = ["log_chars", "log_words", "word_mean", "word_sd", "upper", "digit", "symbol", "pipe", "bang", "stop", "letter", "distinct", "top_word", "stutter", "short", "dup_lines", "line_mean", "pair_distinct", "closed"]


def document_stats(text: bytes) -> list[float]:
    """One value for each of ``NAMES``; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    shares = class_counts(text)[0] / size
    lens = np.fromiter(map(len, words), np.int64, n)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    top = np.bincount(codes).max() / n
    stutter = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
    pairs = len(np.unique(codes[1:] * n + codes[:-1])) / (n - 1) if n > 1 else 1.0
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(np.log1p(size)), float(np.log1p(n)), min(float(lens.mean()), 40.0), min(float(lens.std()), 40.0), *map(float, shares),
        len(ids) / n ** 0.8, float(top), stutter, float((lens <= 3).mean()), 1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(size / max(1, len(lines)))), pairs, sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
    ]
