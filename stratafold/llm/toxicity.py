"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Learning: on a bounded sample of labelled documents (``SAMPLE`` rows outside the held-out fold, whole texts) each word, and
each word beginning of ``PREFIXES`` letters, gets the log-odds of standing in a toxic document, with a Dirichlet prior of
``PRIOR`` documents dealt to the labels in proportion to their sizes. Only entries whose deviance from chance, as a signed root, is
``LEAST_Z`` or more enter the model; a word takes the entry whose log-odds, a deviation nearer to zero, are
farthest from it, and a word without entry is neutral.

Scoring: a word's score is its log-odds less ``DRIFT``, so that ordinary text falls; a word next to itself counts once, so that a stuttered word is no passage. A linear scan finds every maximal
scoring segment (Ruzzo and Tompa, 1999). For segments of ordinary text the highest score of n words follows an extreme-value law,
P(S >= x) = 1 - exp(-K n exp(-lambda x)) (Karlin and Altschul, 1990), with lambda and K from the sample's clean documents. The r best
segments have a common p-value (Karlin and Altschul, 1993); a document takes the smallest, and a logistic curve
through the sample turns its logarithm into a score from 0 to 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import batch, fold, settle, sized, strings, texts

SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
LEAST_DOCS = 3
LEAST_Z = 3.5
PRIOR = 1.0
DRIFT = 0.25
CACHED_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_MIN_LOG = -700.0


def entries(word: str) -> list[str]:
    """A word's own entry and those of its beginnings."""
    word = word.lower()
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past last, score) in order, in time linear in their candidates.

    Only positive scores can begin or end a segment, so runs between them enter as sums. Candidates stand on a stack with the
    running sums before and after them; a new one joins back to the last candidate with a smaller sum before it if that one ends lower.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # first, past last, sum before, sum after, last candidate with a smaller sum before
    for i in at.tolist():
        first, last, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, last, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # entry to log-odds, and root deviance from chance
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    middle: float = 5.0

    def word(self, word: str) -> float:
        found = [self.weights[e] for e in entries(word) if e in self.weights]
        return (max(found, key=lambda x: abs(x[0]) * (1 - 1 / x[1]))[0] if found else 0.0) - DRIFT

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Minus the natural logarithm of the document's p-value: the best over the r highest segments, r from 1."""
        if not segments:
            return 0.0
        x = np.sort([s for *_, s in segments])[::-1] * self.lam - np.log(self.k * n)
        best = max(0.0, x[0] if x[0] > 2 else -np.log(-np.expm1(-np.exp(-x[0]))))
        sums, logs = np.cumsum(x), 0.0
        for r in range(2, len(x) + 1):
            logs += np.log(r) + np.log(r - 1)  # of r! (r - 1)!
            if x[r - 1] <= 0:
                break
            best = max(best, sums[r - 1] - (r - 1) * np.log(max(sums[r - 1], 1.0)) + logs)
        return float(best)

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(np.clip(self.slope * (self.middle - evidence), -500, 500))))


class Scorer(dict):
    """Word scores of a model, kept for the last words seen."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        value = self[word] = self.model.word(word)
        return value

    def scan(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = _WORD.findall(text)
        scores = np.fromiter(map(self.__getitem__, words), float, len(words))
        for i in np.flatnonzero(scores > 0).tolist():
            if i and words[i].lower() == words[i - 1].lower():
                scores[i] = -DRIFT
        return maximal_segments(scores), len(words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per entry and label, added up before the shuffle."""
    schema = pa.schema([("entry", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
    counts = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        made = batch({"entry": keys, "clean": [counts[0][k] for k in keys], "toxic": [counts[1][k] for k in keys]}, schema)
        counts[0].clear()
        counts[1].clear()
        return made

    for b in sized(batches, "text"):
        for label, text in zip(b["toxic"].to_pylist(), strings(b["text"]), strict=True):
            counts[label].update({e for w in set(_WORD.findall(text)) for e in entries(w)})
        if len(counts[0]) + len(counts[1]) > 400_000:
            yield out()
    yield out()


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Of each sampled document: label, words, segment scores, and how often each word score occurs."""
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64())), ("scores", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))])
    scorer = Scorer(model)
    for b in sized(batches, "text"):
        rows = []
        for label, text in zip(b["toxic"].to_pylist(), strings(b["text"]), strict=True):
            segments, n = scorer.scan(text)
            seen = Counter(round(scorer[w], 2) for w in _WORD.findall(text))
            rows.append((label, n, [s for *_, s in segments], list(seen), list(seen.values())))
        yield batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)


def _lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1; 1, where scores are natural log-odds, if there is none."""
    low, high = 0.02, 4.0
    value = lambda x: float((share * np.exp(x * scores)).sum() - 1)
    if scores.max(initial=-1) <= 0 or value(low) >= 0 or value(high) <= 0:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the curve through (x, y) by Newton steps, with the targets drawn in by Platt's rule."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.minimum(x, 60.0)
    a, b = 0.1, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, target - p
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * z).sum(), g.sum()]))
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-7:
            break
    a = max(a, 1e-3)
    return float(a), float(-b / a)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``sample`` labelled documents at most, in the order of a hash of their ids, none of the held-out fold.

    Without documents of both labels the model knows no word, and every text scores near 0.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(fold("doc_id", FOLDS) != HELD_OUT).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = settle(texts(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model()
    p1, p0 = n1 / (n0 + n1), n0 / (n0 + n1)
    seen, toxic, clean = F.col("clean") + F.col("toxic"), F.col("toxic"), F.col("clean")
    delta = F.log((toxic + PRIOR * p1) / ((n1 + PRIOR) * F.lit(1.0))) - F.log((clean + PRIOR * p0) / ((n0 + PRIOR) * F.lit(1.0)))
    part = lambda y, p: F.when(y > 0, y * F.log(y / (seen * p))).otherwise(0.0)
    root = F.sqrt(2 * F.greatest(part(toxic, p1) + part(clean, p0), F.lit(0.0)))
    counted = rows.mapInArrow(_count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # half a document more on either side keeps a word of one class finite
    odds = lambda a, n: F.log((a + 0.5) / (F.lit(n + PRIOR + 0.5) - a))
    weighed = counted.filter(seen >= LEAST_DOCS).select("entry", delta.alias("delta"), root.alias("root")).filter(F.col("root") >= LEAST_Z)
    weights = {r["entry"]: (r["delta"], r["root"]) for r in weighed.collect()}
    model = Model(weights)
    scanned = rows.mapInArrow(partial(_scan, model=model), "toxic int, n long, segments array<double>, scores array<double>, times array<long>").collect()
    clean = Counter()
    for r in scanned:
        if not r["toxic"]:
            for s, t in zip(r["scores"], r["times"], strict=True):
                clean[s] += t
    if clean:
        at, times = (np.array(x, float) for x in zip(*sorted(clean.items()), strict=True))
        model.lam = _lambda(at, times / times.sum())
        best = [(r["n"], max(r["segments"], default=0.0)) for r in scanned if not r["toxic"] and r["n"]]
        model.k = float(np.clip(len(best) / max(1e-9, sum(n * np.exp(-model.lam * s) for n, s in best)), 1e-6, 1.0))
    found = np.array([model.evidence([(0, 0, s) for s in r["segments"]], r["n"]) for r in scanned])
    model.slope, model.middle = _logistic(found, np.array([r["toxic"] for r in scanned], float))
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64())])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for b in sized(batches, "text"):
        rows = []
        for doc, held, text in zip(b["doc_id"].to_pylist(), b["held_out"].to_pylist(), strings(b["text"]), strict=True):
            segments, n = scorer.scan(text)
            score = model.score(model.evidence(segments, n))
            rows.append((doc, held, score, int(score >= THRESHOLD), sum(model.k * n * np.exp(-model.lam * s) < 0.01 for *_, s in segments)))
        yield batch(dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)), _OUT)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) of each row; null, empty and wordless texts have no evidence."""
    return texts(docs).withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def _passages(batches: Iterator[pa.RecordBatch], model: Model, expected: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64()), ("e_value", pa.float64())])
    scorer = Scorer(model)
    for b in sized(batches, "text"):
        rows = []
        for doc, text in zip(b["doc_id"].to_pylist(), strings(b["text"]), strict=True):
            segments, n = scorer.scan(text)
            found = [(a, z, s, e) for a, z, s in segments if (e := float(model.k * n * np.exp(-model.lam * s))) <= expected]
            spans = [m.span() for m in _WORD.finditer(text)] if found else []
            rows += [(doc, spans[a][0], spans[z - 1][1], text[spans[a][0] : spans[z - 1][1]], s, e) for a, z, s, e in found]
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)


def passages(docs: DataFrame, model: Model, expected: float = 0.01) -> DataFrame:
    """Every passage of which ``expected`` or fewer are to be expected by chance: characters from start to before end."""
    return texts(docs).mapInArrow(partial(_passages, model=model, expected=expected), "doc_id long, start long, end long, text string, score double, e_value double")
