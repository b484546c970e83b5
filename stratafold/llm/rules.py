"""Quality rules: base counts, and a linear-chain conditional random field over the lines of a text.

The field has two labels, content and boilerplate, weights for features of a line, and weights for pairs of
neighbouring labels. It is trained on a bounded sample of labelled documents (``SAMPLE`` documents, ``RUNS`` runs of ``RUN`` lines from each, evenly over the text). Their
lines have no labels, so these are latent: the field so far decodes them, held to what the document's label says of the share of content, and is trained on that,
``TURNS`` times from a prior. So lines differ inside a document, and the pair weights come from real changes between them. Viterbi decoding marks the lines of a text, and
a text is kept if at least ``CONTENT_SHARE`` of its words stand in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import batch, sized, texts, utf8
from stratafold.llm.docstats import CLASSES, class_counts

SAMPLE = 2000
RUN, RUNS = 32, 32  # lines in a run, and runs of a document, that training sees
TURNS = 3
CONTENT_SHARE = 0.5
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATS = 30  # per cent of the words
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"

FEATURES = [*CLASSES, "marks", "distinct", "word_len", "log_words", "repeated_line", "closed", "one"]
_MARKS = [CLASSES.index("symbol"), CLASSES.index("bang")]
#: Prior weights for boilerplate against content, before any label is seen: symbols, pipes, bangs and few distinct words.
PRIOR = {"symbol": 8.0, "pipe": 8.0, "bang": 8.0, "marks": 2.0, "upper": 2.0, "distinct": -3.0, "repeated_line": 1.0, "one": 0.5}
PRIOR_PAIRS = np.array([[0.5, -0.5], [-0.5, 0.5]])


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser of word numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in some window of ``window`` words found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    h = _mixed(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n))
    if len(ids) > n - 1:
        return 0
    key = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        key = (key ^ h[k : k + len(key)]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def line_table(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and word counts of the lines that have a word, and how many of them equal an earlier line."""
    lines = text.split(b"\n")
    at = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])
    split = [x.split() for x in lines]
    counts = np.fromiter(map(len, split), np.int64, len(lines))
    full = np.flatnonzero(counts)
    if not len(full):
        return np.zeros((0, len(FEATURES))), counts[:0], 0
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    seen: set[bytes] = set()
    again = np.zeros(len(lines))
    for k in full.tolist():
        if lines[k] in seen:
            again[k] = 1
        seen.add(lines[k])
    shares = class_counts(text, at) / np.maximum(size, 1)[:, None] if len(lines) > 1 else class_counts(text) / max(1, len(text))
    distinct = np.array([len(set(split[k])) for k in full]) / counts[full]
    words_len = np.minimum(size[full] / counts[full], 30) / 10
    closed = np.array([lines[k].rstrip().endswith((b".", b"?", b"!")) for k in full], float)
    marks = np.minimum((shares[full] * size[full, None])[:, _MARKS].sum(1) / counts[full], 2)  # symbols and bangs a word
    x = np.column_stack([shares[full], marks, distinct, words_len, np.log1p(counts[full]) / 4, again[full], closed, np.ones(len(full))])
    return x, counts[full], int(again.sum())


class LineField:
    """The linear-chain field: ``weights`` score boilerplate against content, ``pairs`` score neighbouring labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @classmethod
    def prior(cls) -> LineField:
        return cls(np.array([PRIOR.get(k, 0.0) for k in FEATURES]), PRIOR_PAIRS.copy())

    def boilerplate(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely labels of a sequence of lines, True where boilerplate; ties are content."""
        score = x @ self.weights
        if not len(score):
            return np.zeros(0, bool)
        (cc, cb), (bc, bb) = self.pairs.tolist()
        content, boiler, back = 0.0, float(score[0]), []
        for s in score[1:].tolist():
            stay, come = content + cc, boiler + bc
            fall, keep = content + cb, boiler + bb
            back.append((come > stay, keep > fall))
            content, boiler = max(stay, come), s + max(fall, keep)
        label, out = boiler > content, []
        for from_content, from_boiler in reversed(back):
            out.append(label)
            label = from_boiler if label else from_content
        return np.array([*reversed([*out, label])], bool)

    @classmethod
    def train(cls, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> LineField:
        """Gradient ascent (Adam) on the conditional likelihood of runs of lines with a label each (1 boilerplate), drawn to the prior; both labels weigh the same."""
        field = cls.prior()
        every = np.concatenate([*labels, np.zeros(0)])
        if len(set(every.tolist())) < 2:
            return field
        b, f, width = len(sequences), len(FEATURES), max(map(len, sequences))
        xs, mask, gold = np.zeros((b, width, f)), np.zeros((b, width)), np.zeros((b, width))
        for k, (x, y) in enumerate(zip(sequences, labels, strict=True)):
            xs[k, : len(x)], mask[k, : len(x)], gold[k, : len(x)] = x, 1, y
        each = np.where(gold == 1, 0.5 / max(1.0, (mask * gold).sum()), 0.5 / max(1.0, (mask * (1 - gold)).sum())) * mask
        share = each.sum(1) / np.maximum(mask.sum(1), 1)  # a run weighs as its lines do on average
        theta = np.concatenate([field.weights, field.pairs.ravel()])
        first, m, v = theta.copy(), np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            grad = cls._gradient(theta, xs, mask, gold, share, f) - ridge * (theta - first)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[:f], theta[f:].reshape(2, 2))

    @classmethod
    def learn(cls, runs: list[tuple[np.ndarray, np.ndarray, int]], turns: int = TURNS) -> LineField:
        """A field from runs (line features, words a line, 1 if the document is of low quality) whose lines have no labels of their own.

        Labels are latent: each turn decodes the runs with the field so far, held to what the document's label says (``explain``), and trains on the result.
        """
        field = cls.prior()
        for _ in range(turns):
            field = cls.train([x for x, _, _ in runs], [field.explain(*run) for run in runs])
        return field

    def explain(self, x: np.ndarray, words: np.ndarray, low: int) -> np.ndarray:
        """The likeliest labels of a run that agree with its document: half of the words or more are boilerplate if it is of low quality, else less than half.

        Lines that must change are those whose own scores speak least against it.
        """
        found, score = self.boilerplate(x).astype(float), x @ self.weights
        order = np.argsort(-score if low else score, kind="stable")
        for k in order:
            share = (found * words).sum() / max(1, words.sum())
            if (share >= 0.5) == bool(low):
                break
            found[k] = float(low)
        return found

    @staticmethod
    def _gradient(theta: np.ndarray, xs: np.ndarray, mask: np.ndarray, gold: np.ndarray, share: np.ndarray, f: int) -> np.ndarray:
        """Observed less expected features, by the forward and backward recursions; ``gold`` is a label for each run or for each line."""
        gold = np.broadcast_to(gold[:, None], mask.shape) if gold.ndim == 1 else gold
        w, pairs = theta[:f], theta[f:].reshape(2, 2)
        b, width, _ = xs.shape
        unary = np.stack([np.zeros((b, width)), xs @ w], axis=2)
        alpha, beta = np.zeros((b, width, 2)), np.zeros((b, width, 2))
        alpha[:, 0] = unary[:, 0]
        for k in range(1, width):
            new = np.logaddexp(alpha[:, k - 1, :1] + pairs[0], alpha[:, k - 1, 1:] + pairs[1]) + unary[:, k]
            alpha[:, k] = np.where(mask[:, k, None] > 0, new, alpha[:, k - 1])
        for k in range(width - 2, -1, -1):
            ahead = beta[:, k + 1] + unary[:, k + 1]
            new = np.logaddexp(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
            beta[:, k] = np.where(mask[:, k + 1, None] > 0, new, beta[:, k + 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]) * mask
        weight = share[:, None] * mask
        dw = np.einsum("bl,blf->f", (gold - p) * weight, xs)
        dp = np.zeros((2, 2))
        both = weight[:, 1:]
        for i in range(2):
            for j in range(2):
                e = np.exp(alpha[:, :-1, i] + pairs[i, j] + unary[:, 1:, j] + beta[:, 1:, j] - total[:, None])
                dp[i, j] = ((((gold[:, :-1] == i) & (gold[:, 1:] == j)) - e) * both).sum()
        return np.concatenate([dw, dp.ravel()])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``RUN`` lines, evenly over the whole text and ``RUNS`` at most, with the words of each line."""
    schema = pa.schema([("quality", pa.int32()), ("lines", pa.binary()), ("words", pa.binary())])
    for b in batches:
        for q, text in zip(b["quality"].to_pylist(), utf8(b["text"]), strict=True):
            x, words, _ = line_table(text)
            starts = np.arange(0, len(x), RUN)
            starts = starts[np.unique(np.linspace(0, len(starts) - 1, min(RUNS, len(starts))).round().astype(int))] if len(starts) else starts
            runs = [(x[k : k + RUN], words[k : k + RUN]) for k in starts]
            yield batch({"quality": [q] * len(runs), "lines": [np.ascontiguousarray(v, np.float32).tobytes() for v, _ in runs], "words": [w.astype(np.int32).tobytes() for _, w in runs]}, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """A field from ``sample`` labelled documents at most, taken in the order of a hash of their ids, and ``RUNS`` runs of lines from each."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(_lines, "quality int, lines binary, words binary").collect()
    rows = sorted((r["quality"], bytes(r["lines"]), bytes(r["words"])) for r in rows)
    return LineField.learn([(np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(float), np.frombuffer(w, np.int32), 1 - q) for q, x, w in rows])


def judge(text: bytes, field: LineField, share: float = CONTENT_SHARE) -> tuple[int, int, int, int, int, bool, float, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content share, kept."""
    words = text.split()
    n = len(words)
    chars = sum(len(w) for w in words) if text.isascii() else len(text.decode()) - sum(map(text.count, (_SPACES[k : k + 1] for k in range(6))))
    symbols = sum(text.count(_SYMBOLS[k : k + 1]) for k in range(8))
    repeats = repeated_words(words)
    x, counts, dups = line_table(text)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATS * n
    content = float(counts[~field.boilerplate(x)].sum() / n) if n else 0.0
    return n, chars, symbols, dups, repeats, failed, content, not failed and content >= share


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
_OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())])


def _judge(batches: Iterator[pa.RecordBatch], field: LineField) -> Iterator[pa.RecordBatch]:
    for b in sized(batches, "text"):
        rows = [(d, *judge(x, field)) for d, x in zip(b["doc_id"].to_pylist(), utf8(b["text"]), strict=True)]
        yield batch(dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)), _OUT)


def annotate(docs: DataFrame, field: LineField) -> DataFrame:
    """The verdict on every row of ``docs`` by ``field``; null and empty texts have no words and fail the base rules."""
    return texts(docs).mapInArrow(partial(_judge, field=field), OUT)


def _keep(batches: Iterator[pa.RecordBatch], field: LineField) -> Iterator[pa.RecordBatch]:
    for b in sized(batches, "text"):
        yield b.filter(pa.array([judge(x, field)[-1] for x in utf8(b["text"])], pa.bool_()))


def keep(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return docs.mapInArrow(partial(_keep, field=field), docs.schema)
