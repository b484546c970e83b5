"""Language-model scoring: a causal self-attention model over subword ids beside a unigram base over words.

Tokens are lower-cased (A-Z) words and one end; their subword ids, each word with a space before it, and an end id form one sequence. The model
predicts the class of the next id and then the id in its class:

* class logits are a table row of the last id (from counts of neighbours) plus the output of one causal self-attention head over the last
  ``SPAN`` to ``2 * SPAN`` ids with relative position biases;
* an id in its class follows its counts after the last id, drawn to its overall share of the class, so that all ids together have probability one.

Counts are sums over all training documents. The attention is trained on every id of every training document, once, in the blocks that scoring sees: in each of ``ROUNDS`` turns each
partition takes Adam steps over its share of blocks, in runs of ``RUN`` that share keys, from common parameters, and the parameters are averaged. A text is cut into blocks of ``SPAN`` ids that also see the
block before, so windows overlap and every id is predicted once; blocks of many texts form one batch, masked to the past and their own text.
``graphs`` does the arithmetic of a batch by ``onnxruntime``; ``forward`` and ``gradients`` are the same in numpy, for where that is missing.

Base scores need the count of every word. The most frequent words, at most ``HEAD_WORDS``, go to every task; all other words are summed up by a join.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import batch, fold, settle, sized, texts, tokenizer_path

FOLDS, HELD_OUT = 7, 2
SPAN = 16
DIM = 16
CLASSES, BINS = 128, 32
PREVIOUS = 512
DENSE_IDS = 4096
DRAW = 20.0
ROUNDS = 2
BATCH = 128
RUN = 4
RATE = 0.02
HEAD_WORDS = 200_000
CHUNK = 8 << 20
WAITING_COUNTS = 1_000_000
WAITING_PAIRS = 4_000_000
TREE = 64
SEED = 8


LOWER, SPACES = bytes(range(256)).lower(), b" \t\n\v\f\r"


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, lower-cased (A-Z), as one dictionary array of bytes, and the words of each text."""
    column = column.cast(pa.binary())
    _, stops, data = column.buffers()
    stops = np.frombuffer(stops, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)[stops[0] : stops[-1]]
    stops = stops - stops[0]
    inside = data - np.uint8(9) > 4  # \t to \r
    inside &= data != 32
    cuts = np.zeros(len(data) + 1, bool)  # where a text begins
    cuts[stops] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cuts[1:-1]
    last[:-1] &= ~inside[1:] | cuts[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    ends = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes().translate(LOWER, SPACES))])
    return words.dictionary_encode(), np.diff(np.searchsorted(first, stops))


class Subwords:
    """Ids of lower-cased words. A chunk of texts is spelled by its distinct words; in it place 0 is the end, which is no word, and place 1 + i the word i of its dictionary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.starts[i] = token[:1] == b" "

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the places of a chunk behind each other, uint16, and how many each has."""
        _, stops, data = words.buffers()
        stops = np.frombuffer(stops, np.int32)[: len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
        starts = stops + np.arange(len(stops))  # with a space before each word
        spaced = np.full(starts[-1], 32, np.uint8)
        is_word = np.ones(len(spaced), bool)
        is_word[starts[:-1]] = False
        spaced[is_word] = np.frombuffer(data or b"", np.uint8)[: stops[-1]]
        flat, n = [np.array([self.end], np.uint16)], [np.ones(1, np.int64)]
        for at in range(0, len(words), 4096):
            cuts = starts[at : at + 4097]
            text = spaced[cuts[0] : cuts[-1]].tobytes()
            got = self.encoding.encode_to_numpy(text.decode(), disallowed_special=()).astype(np.uint16)  # without a list of numbers
            begins = np.flatnonzero(self.starts[got])
            if len(begins) != len(cuts) - 1:  # a word with white space beyond ASCII
                each = [self.encoding.encode_ordinary((b" " + w).decode()) for w in text.split(b" ")[1:]]
                got, begins = np.array(list(chain.from_iterable(each)), np.uint16), np.cumsum([0, *map(len, each[:-1])])
            flat.append(got)
            n.append(np.diff(begins, append=len(got)))
        return np.concatenate(flat), np.concatenate(n)

    def read(self, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of a chunk of texts; places of all words, an end after each text and one before the first; their ids, and where the ends are among these."""
        words, sizes = words_of(column)
        places = np.zeros(1 + len(words) + len(sizes), np.int32)
        is_word = np.ones(len(places), bool)
        is_word[np.concatenate([[0], np.cumsum(sizes + 1)])] = False
        places[is_word] = words.indices.to_numpy() + 1
        flat, n = self.spell(words.dictionary)
        here = n[places]
        stop = np.cumsum(here)
        at = np.repeat((np.cumsum(n) - n)[places] - stop + here, here)
        at += np.arange(len(at))
        return words, places, flat[at], stop[places == 0] - 1


#: Kept by a worker for its later tasks.
subwords_of = cache(Subwords)


def _summed(keys: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Each key once, with the sum of its counts."""
    every = pa.chunked_array(keys).combine_chunks().dictionary_encode()
    return every.dictionary, np.bincount(every.indices.to_numpy(), np.concatenate(counts), len(every.dictionary)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (kind 0) and of neighbouring ids (kind 1, key last * 65536 + id), and the ids of each document (kind 2)."""
    schema = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    subwords, words, pairs, waiting = subwords_of(path), ([], []), ([], []), []

    def out(kind: int, n: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
        made = {"kind": pa.array(np.full(len(n), kind, np.int32)), "n": pa.array(n)} | columns
        return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(n), f.type)).cast(f.type) for f in schema], schema=schema)

    def flush(counts: tuple[list, list], most: int, kind: int, name: str) -> Iterator[pa.RecordBatch]:
        """Sums up counts of more than ``most`` keys and yields them if that leaves more than half."""
        if counts[0] and sum(map(len, counts[0])) > most:
            keys, n = _summed(*counts)
            counts[0][:], counts[1][:] = [keys], [n]
            if 2 * len(n) > most:
                yield out(kind, n, **{name: keys})
                counts[0].clear()
                counts[1].clear()

    def count_pairs() -> None:
        keys, n = np.unique(np.concatenate(waiting), return_counts=True)
        pairs[0].append(pa.array(keys))
        pairs[1].append(n)
        waiting.clear()

    for b in sized(batches, "text", CHUNK):
        found, _, ids, ends = subwords.read(b["text"])
        words[0].append(found.dictionary)
        words[1].append(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)))
        waiting.append((ids[:-1].astype(np.uint32) << np.uint32(16)) + ids[1:])
        raw, at = ids.astype("<u2").tobytes(), (2 * ends).tolist()
        yield out(2, np.ones(b.num_rows, np.int64), ids=pa.array([raw[i : j + 2] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()))
        if sum(map(len, waiting)) > WAITING_PAIRS:
            count_pairs()
        yield from flush(words, WAITING_COUNTS, 0, "word")
        yield from flush(pairs, WAITING_COUNTS, 1, "key")
    if waiting:
        count_pairs()
    yield from flush(words, 0, 0, "word")
    yield from flush(pairs, 0, 1, "key")


@dataclass
class Model:
    classes: np.ndarray  # of each id
    last: np.ndarray  # row of each id as the last one
    table: np.ndarray  # (PREVIOUS, CLASSES): class logits after a last id
    dense: np.ndarray  # column of each id in ``after``, -1 for none
    after: np.ndarray  # (PREVIOUS, dense ids): log10 probability in the class after a last id
    loose: np.ndarray  # (PREVIOUS, CLASSES): log10 share left to an id's overall probability
    overall: np.ndarray  # of each id: log10 share of its class
    end: int
    params: list[np.ndarray] | None = None  # queries, keys, values, biases, output

    def start(self) -> list[np.ndarray]:
        rng = np.random.default_rng(SEED)
        made = [rng.normal(size=(PREVIOUS, DIM)) * 0.3 for _ in range(3)]
        return [x.astype(np.float32) for x in (*made, np.zeros(2 * SPAN), np.zeros((DIM, CLASSES)))]


def order_of(unigrams: np.ndarray) -> np.ndarray:
    """Ids by falling frequency."""
    return np.lexsort((np.arange(len(unigrams)), -unigrams))


def classes_of(unigrams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each id: the most frequent ids have their own, the others share bins of falling frequency, by whether they begin a word."""
    order, classes, single = order_of(unigrams), np.zeros(len(unigrams), np.int64), CLASSES - BINS
    classes[order[:single]] = np.arange(single)
    for s in (False, True):
        rest = order[single:][starts[order[single:]] == s]
        share = np.cumsum(unigrams[rest] + 1e-9)
        classes[rest] = single + s * (BINS // 2) + np.minimum((share / max(share[-1], 1e-12) * (BINS // 2)).astype(int), BINS // 2 - 1) if len(rest) else 0
    return classes


def build(counts: np.ndarray, by_class: np.ndarray, unigrams: np.ndarray, starts: np.ndarray, end: int, last: np.ndarray) -> Model:
    """Tables from counts: ``unigrams`` of ids, ``counts`` (PREVIOUS, frequent ids in their order) and ``by_class`` (PREVIOUS, CLASSES) of all ids after a last id."""
    size, order, classes = len(unigrams), order_of(unigrams), classes_of(unigrams, starts)
    in_class, ids_in_class = np.bincount(classes, unigrams, CLASSES), np.bincount(classes, minlength=CLASSES)
    overall = (unigrams + 0.5) / (in_class + 0.5 * ids_in_class)[classes]
    keep = order[: counts.shape[1]]
    dense = np.full(size, -1, np.int64)
    dense[keep] = np.arange(len(keep))
    kept, kept_share = np.zeros((PREVIOUS, CLASSES)), np.bincount(classes[keep], overall[keep], CLASSES)
    for k in range(CLASSES):
        kept[:, k] = counts[:, classes[keep] == k].sum(1)
    shares = (in_class + 0.5) / (in_class + 0.5).sum()
    table = np.log((by_class + DRAW * shares) / (by_class.sum(1, keepdims=True) + DRAW))
    after = np.log10((counts + DRAW * overall[keep]) / (by_class[:, classes[keep]] + DRAW))
    # what a class has beyond the frequent ids is dealt to its other ids by their overall shares
    others = np.maximum(1 - kept_share, 1e-12)
    loose = np.log10(((by_class - kept) / others + DRAW) / (by_class + DRAW))
    return Model(classes, last, table.astype(np.float32), dense, after.astype(np.float32), loose.astype(np.float32), np.log10(overall).astype(np.float32), end)


@cache
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Relative positions of the 2 * SPAN keys of the block before and its own to a block's SPAN queries, and which keys they see."""
    rel = SPAN + np.arange(SPAN)[None] - np.arange(2 * SPAN)[:, None]
    return np.clip(rel, 0, 2 * SPAN - 1), rel >= 0


@dataclass
class Blocks:
    """Texts cut to blocks of SPAN ids: last ids' rows and next ids, which of them are real, and the blocks that begin a text."""

    x: np.ndarray
    y: np.ndarray
    real: np.ndarray
    begins: np.ndarray
    first: np.ndarray  # block that begins each text
    sizes: np.ndarray  # ids to score in each text


def blocks_of(sequences: list[np.ndarray], model: Model) -> Blocks:
    """Every id of a text but the first, which stands before it, is the next id at one place of one block."""
    sizes = np.array([len(s) - 1 for s in sequences], np.int64)
    n_blocks = -(-sizes // SPAN)
    first = np.cumsum(n_blocks) - n_blocks
    total = int(n_blocks.sum())
    x, y, rows = np.zeros(total * SPAN, np.uint16), np.zeros(total * SPAN, np.uint16), model.last.astype(np.uint16)
    for at, n, s in zip((first * SPAN).tolist(), sizes.tolist(), sequences, strict=True):
        x[at : at + n], y[at : at + n] = s[:-1], s[1:]
    left = np.repeat(sizes + first * SPAN, n_blocks) - np.arange(total) * SPAN
    real = np.arange(SPAN) < left[:, None]
    begins = np.zeros(total, bool)
    begins[first[n_blocks > 0]] = True
    x = rows[x]
    x[~real.ravel()] = 0
    return Blocks(x.reshape(total, SPAN), y.reshape(total, SPAN), real, begins, first, sizes)


class Work:
    """Buffers for batches of at most ``most`` blocks: fresh ones would cost more than the arithmetic."""

    def __init__(self, most: int, train: bool = False, classes: int = CLASSES, dtype: type = np.float32):
        self.most, f = most, lambda *shape: np.empty(shape, dtype)
        self.q, self.turned, self.o, self.k, self.v = f(most, SPAN, DIM), f(most, DIM, SPAN), f(most, SPAN, DIM), f(2 * most, SPAN, DIM), f(2 * most, SPAN, DIM)
        self.s, self.logits, self.drift = f(most, 2 * SPAN, SPAN), f(most * SPAN, classes), f(most * SPAN, classes)
        self.ones = np.ones(classes, dtype)
        if train:
            self.do, self.dq, self.da = f(most, SPAN, DIM), f(most, SPAN, DIM), f(most, 2 * SPAN, SPAN)
            self.pair, self.sum = f(most, 2, SPAN, DIM), f(2 * most, SPAN, DIM)


def _windows(blocks: np.ndarray) -> np.ndarray:
    """(runs, each + 1, SPAN, DIM) as (runs, each, 2 * SPAN, DIM): every block but the first behind the one before it, without a copy."""
    runs, more, _, _ = blocks.shape
    return np.ndarray((runs, more - 1, 2 * SPAN, DIM), blocks.dtype, blocks, 0, blocks.strides)


def _parts(n: int, parts: int) -> int:
    """Products of small parts stay in cache."""
    return 1 if n % parts else parts


def forward(params: list[np.ndarray], table: np.ndarray, now: np.ndarray, before: np.ndarray, alone: np.ndarray, work: Work) -> tuple[np.ndarray, ...]:
    """Attention and class logits of blocks, as views of ``work``.

    ``now``, rows of last ids, is ``len(before)`` runs of blocks that follow each other, equally long; ``before`` has the block before each run. ``alone`` blocks do
    not see the block before them. Attention is keys by queries and not divided by its sums, which are returned.
    """
    q_of, k_of, v_of, bias, w = params
    n, runs = len(now), len(before)
    each = n // runs
    q, o, s = work.q[:n], work.o[:n], work.s[:n]
    logits, drift = work.logits[: n * SPAN], work.drift[: n * SPAN]
    rel, open_ = _masks()
    rows = np.concatenate([before[:, None], now.reshape(runs, each, SPAN)], 1)
    np.take(q_of * q_of.dtype.type(1 / math.sqrt(DIM)), now, 0, q, "clip")
    k, v = (x[: n + runs].reshape(runs, each + 1, SPAN, DIM) for x in (work.k, work.v))
    np.take(k_of, rows, 0, k, "clip")
    np.take(v_of, rows, 0, v, "clip")
    k, v = _windows(k), _windows(v)
    turned = work.turned[:n]
    turned[:] = q.transpose(0, 2, 1)
    by_run = s.reshape(runs, each, 2 * SPAN, SPAN)
    np.matmul(k, turned.reshape(runs, each, DIM, SPAN), by_run)
    s += np.where(open_, bias[rel], -1e9).astype(s.dtype)
    s[alone, :SPAN] = -1e9
    np.clip(s, -1e9, 60, s)
    np.exp(s, s)
    sums = np.matmul(np.ones((1, 2 * SPAN), s.dtype), s).reshape(n, SPAN, 1)
    np.matmul(by_run.transpose(0, 1, 3, 2), v, o.reshape(runs, each, SPAN, DIM))
    o /= sums
    parts = _parts(n, 8)
    np.matmul(o.reshape(parts, -1, DIM), w, logits.reshape(parts, -1, logits.shape[1]))
    logits += np.take(table, now.ravel(), 0, drift, "clip")
    return q, k, v, s, sums, o, logits, rows


def gradients(params: list[np.ndarray], table: np.ndarray, now: np.ndarray, before: np.ndarray, alone: np.ndarray, y: np.ndarray, real: np.ndarray, work: Work) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the real targets of blocks and its gradients; y: classes of next ids. Factors of a row are put on its DIM side, not on its classes or keys."""
    w, n, runs = params[4], len(now), len(before)
    each = n // runs
    q, k, v, a, sums, o, logits, rows = forward(params, table, now, before, alone, work)
    at, weight = np.arange(n * SPAN) * logits.shape[1] + y.ravel(), real.ravel() / max(1.0, float(np.count_nonzero(real)))
    own = logits.ravel()[at]
    np.exp(logits, logits)
    total = logits @ work.ones
    loss = float(((np.log(total) - own) * weight).sum())
    d = logits
    d.ravel()[at] -= total
    weight = (weight / total).astype(w.dtype).reshape(n, SPAN, 1)
    parts = _parts(n, 32)
    dw = np.matmul((o * weight).reshape(parts, -1, DIM).transpose(0, 2, 1), d.reshape(parts, -1, d.shape[1])).sum(0)
    do, da, turned = work.do[:n], work.da[:n], work.turned[:n]
    np.matmul(d, w.T, do.reshape(-1, DIM))
    do *= weight / sums
    own_part = np.einsum("nsk,nsk->ns", do, o)
    tiled = np.tile(own_part, SPAN)[:, None]  # long rows subtract faster than short ones
    turned[:] = do.transpose(0, 2, 1)
    by_run = da.reshape(runs, each, 2 * SPAN, SPAN)
    np.matmul(v, turned.reshape(runs, each, DIM, SPAN), by_run)
    halves = da.reshape(n, 2, SPAN * SPAN)
    halves -= tiled
    da *= a
    rel, open_ = _masks()
    dbias = np.bincount(rel.ravel(), (da.sum(0) * open_).ravel(), 2 * SPAN)
    dq, pair, both = work.dq[:n], work.pair[:n].reshape(runs, each, 2, SPAN * DIM), work.sum[: n + runs].reshape(runs, each + 1, SPAN * DIM)
    np.matmul(by_run.transpose(0, 1, 3, 2), k, dq.reshape(runs, each, SPAN, DIM))
    cells, of_keys = _cells(rows), []
    for of, what in ((da, q), (a, do)):  # a block's keys are seen by its own queries and by those of the next block
        np.matmul(of, what, pair.reshape(n, 2 * SPAN, DIM))
        both[:, 0], both[:, -1] = pair[:, 0, 0], pair[:, -1, 1]
        np.add(pair[:, 1:, 0], pair[:, :-1, 1], both[:, 1:-1])
        of_keys.append(_by_cell(cells, both, len(params[1])))
    dq_of = _by_cell(cells[:, 1:], dq, len(params[0]))
    dq_of *= w.dtype.type(1 / math.sqrt(DIM))
    return loss, [dq_of, *of_keys, dbias.astype(w.dtype), dw]


def _cells(rows: np.ndarray) -> np.ndarray:
    """Places of rows of DIM numbers, two at once as a complex one."""
    return np.arange(PREVIOUS * (DIM // 2)).reshape(PREVIOUS, DIM // 2).take(rows, 0)


def _by_cell(cells: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Sums of gradients by the row they belong to."""
    two, out = np.result_type(g.dtype, np.complex64), np.zeros((n, DIM), g.dtype)
    np.add.at(out.view(two).ravel(), cells.ravel(), g.reshape(-1).view(two))
    return out


@cache
def _graphs():
    """The module of the same arithmetic as graphs, or None without ``onnxruntime``."""
    try:
        from stratafold.llm import graphs
    except ImportError as gone:  # another fault is not hidden
        if (gone.name or "").split(".")[0] != "onnxruntime":
            raise
        return None
    return graphs


def gradients_of(model: Model) -> Callable[..., list[np.ndarray]]:
    """``gradients`` of batches of BATCH blocks at most, of (params, now, before, alone, classes of next ids, real)."""
    if graphs := _graphs():
        of_rows = graphs.Gradients(model.params, model.table, *_masks())

        def sums(params: list[np.ndarray], *given: np.ndarray) -> list[np.ndarray]:
            rows, of_queries, of_keys, of_values, *others = of_rows(params, *given)
            cells = _cells(rows)
            return [_by_cell(c, g, PREVIOUS) for c, g in ((cells[:, 1:], of_queries), (cells, of_keys), (cells, of_values))] + others

        return sums
    work = Work(BATCH, True)
    return lambda params, *given: gradients(params, model.table, *given, work)[1]


def class_scores_of(model: Model, blocks: int) -> Callable[..., np.ndarray]:
    """The log probability of the class of each next id in batches of ``blocks`` at most, of (now, before, alone, classes of next ids)."""
    if graphs := _graphs():
        return graphs.Scores(model.params, model.table, *_masks())
    work = Work(blocks)

    def scores(now: np.ndarray, before: np.ndarray, alone: np.ndarray, classes: np.ndarray) -> np.ndarray:
        logits = forward(model.params, model.table, now, before, alone, work)[6]
        own = logits.ravel()[np.arange(len(logits)) * CLASSES + classes.ravel()]
        np.exp(logits, logits)
        return own - np.log(logits @ work.ones)

    return scores


def _flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params]).astype(np.float64)


def _views(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    parts = np.split(flat, np.cumsum([p.size for p in like])[:-1])
    return [x.reshape(p.shape) for x, p in zip(parts, like, strict=True)]


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return [x.astype(np.float32) for x in _views(flat, like)]


def _steps(batches: Iterator[pa.RecordBatch], model: Model, turn: int) -> Iterator[pa.RecordBatch]:
    """Adam over this partition's blocks of one turn; its parameters, weighted by its targets."""
    from pyspark import TaskContext

    flat = np.concatenate([p.ravel() for p in model.params])
    params, t, n = _views(flat, model.params), 0, 0
    m, v, step = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    of_batch = gradients_of(model)
    for b in sized(batches, "ids", 1 << 20):
        texts_ = blocks_of([np.frombuffer(x, "<u2") for x in b["ids"].to_pylist()], model)
        total = len(texts_.x)
        mine = np.random.default_rng(SEED).permutation(-(-total // RUN))[turn::ROUNDS] * RUN
        for at in range(0, len(mine), BATCH // RUN):
            first = mine[at : at + BATCH // RUN]
            i = (first[:, None] + np.arange(RUN)).ravel()
            inside, i = i < total, np.minimum(i, total - 1)  # the last run may be short
            real = texts_.real[i] & inside[:, None]
            grads = of_batch(params, texts_.x[i], texts_.x[np.maximum(first - 1, 0)], texts_.begins[i], model.classes[texts_.y[i]], real)
            t, n = t + 1, n + int(real.sum())
            rate = RATE / (1 + turn) / (1 + t / 800)
            g = np.concatenate([x.ravel() for x in grads])
            m += 0.1 * (g - m)
            g *= g
            g -= v
            g *= 0.01
            v += g
            np.multiply(v, 1 / (1 - 0.99**t), step)
            np.sqrt(step, step)
            step += 1e-7
            np.divide(m, step, step)
            step *= rate / (1 - 0.9**t)
            flat -= step
    yield batch({"slot": [TaskContext.get().partitionId()], "n": [n], "sums": [(_flat(params) * n).tobytes()]}, pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())]))


def _add(rows: pa.Table) -> pa.Table:
    return pa.table({"slot": rows["slot"][:1], "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()), "sums": pa.array([sum(np.frombuffer(x.as_py()) for x in rows["sums"]).tobytes()], pa.binary())})


def train_attention(model: Model, rows: DataFrame) -> Model:
    """Local steps and averages over all texts ``rows.ids``."""
    model.params = model.start()
    parts = rows.rdd.getNumPartitions()
    for turn in range(ROUNDS):
        sums, left = rows.select("ids").mapInArrow(partial(_steps, model=model, turn=turn), "slot long, n long, sums binary"), parts
        while left > TREE:
            left = -(-left // TREE)
            sums = sums.withColumn("slot", F.col("slot") % left).groupBy("slot").applyInArrow(lambda t: _add(t), "slot long, n long, sums binary")
        total, n = 0.0, 0
        for r in sums.collect():  # TREE rows at most, of the parameters' size; together, so that all partitions train at once
            total, n = total + np.frombuffer(bytes(r["sums"])), n + r["n"]
        if n:
            model.params = _shaped(total / n, model.params)
    return model


def log10_scores(model: Model, sequences: list[np.ndarray], blocks: int = 128, of_class: Callable[..., np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each sequence of ids, of which the first stands before it and is not scored."""
    b = blocks_of(sequences, model)
    of_class = of_class or class_scores_of(model, blocks)
    out = np.empty(b.x.size, np.float32)
    after, width = model.after.ravel(), model.after.shape[1]
    for a in range(0, len(b.x), blocks):
        now = b.x[a : a + blocks]
        row, ids = now.ravel().astype(np.int64), b.y[a : a + blocks].ravel()
        cls = model.classes[ids]
        in_classes = of_class(now, b.x[max(a - 1, 0)][None], b.begins[a : a + blocks], cls)
        column = model.dense[ids]
        emit, rest = after.take(row * width + column, mode="clip"), np.flatnonzero(column < 0)
        emit[rest] = model.loose[row[rest], cls[rest]] + model.overall[ids[rest]]
        out[a * SPAN : a * SPAN + len(row)] = in_classes / np.float32(np.log(10)) + emit
    out[~b.real.ravel()] = 0
    sums, any_ = np.zeros(len(b.sizes)), b.sizes > 0
    if any_.any():
        sums[any_] = np.add.reduceat(out, b.first[any_] * SPAN, dtype=float)
    return sums


def _score(batches: Iterator[pa.RecordBatch], path: str, model: Model, head: pa.Array, counts: np.ndarray, ends: int, whole: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.string()))])
    subwords, row, of_class = subwords_of(path), TaskContext.get().partitionId() << 36, class_scores_of(model, 128)
    log_of = np.append(np.log10(counts + 1), np.nan)
    for b in sized(batches, "text", CHUNK):
        words, places, ids, stops = subwords.read(b["text"])
        known = pc.index_in(words.dictionary, value_set=head).fill_null(-1).to_numpy()
        logs = np.concatenate([[np.log10(ends + 1)], log_of[known]])
        scores = log10_scores(model, [ids[i : j + 1] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], 128, of_class)
        places = places[1:]
        stop = np.flatnonzero(places == 0)
        begin, found = np.concatenate([[0], stop[:-1] + 1]), logs[places]
        is_rare = np.isnan(found)
        n_rare = np.add.reduceat(is_rare, begin, dtype=np.int64)
        found[is_rare] = 0
        rare, m = np.flatnonzero(is_rare), len(stop)
        spelled = words.dictionary.take(pa.array(places[rare if not whole else rare[:0]] - 1)).cast(pa.string())
        offsets = np.concatenate([[0], np.cumsum(n_rare) * (not whole)]).astype(np.int32)
        out = {"row": np.arange(row, row + m), "doc_id": b["doc_id"], "held_out": b["held_out"], "n_tokens": stop - begin + 1, "known": stop - begin - n_rare + (ends > 0)}
        out |= {"logs": np.add.reduceat(found, begin), "score": scores, "rare": pa.ListArray.from_arrays(pa.array(offsets), spelled)}
        yield batch(out, schema)
        row += m


def prepare(docs: DataFrame, path: str) -> tuple[Model, DataFrame, dict[int, int], int]:
    """The model, the word counts (word, c), how many words have each count, and the number of training documents of ``docs`` (doc_id, text)."""
    training = docs.filter(fold("doc_id", FOLDS) != HELD_OUT)
    gathered = settle(training.mapInArrow(partial(_gather, path=path), "kind int, word string, key long, n long, ids binary"), "lm-counts")
    words = settle(gathered.filter("kind = 0").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    n_docs = gathered.filter("kind = 2").count()
    spread = {r["c"]: r["n"] for r in words.groupBy("c").agg(F.count("*").alias("n")).collect()}  # at most the root of twice the tokens
    subwords = subwords_of(path)
    pairs = gathered.filter("kind = 1").select(F.shiftright("key", 16).cast("int").alias("last"), F.col("key").bitwiseAND(65535).cast("int").alias("id"), "n")
    unigrams = np.zeros(subwords.size)
    for r in pairs.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary at most
        unigrams[r["id"]] = r["n"]
    order = order_of(unigrams)
    last = np.where(subwords.starts, PREVIOUS - 1, PREVIOUS - 2)
    last[order[: PREVIOUS - 2]] = np.arange(PREVIOUS - 2)
    last[subwords.end] = last[subwords.end] if unigrams[subwords.end] else 0
    width = min(DENSE_IDS, subwords.size)
    column = np.full(subwords.size, -1, np.int64)
    column[order[:width]] = np.arange(width)
    mapped = pairs.mapInArrow(partial(_rows, last=last, column=column, classes=classes_of(unigrams, subwords.starts)), "row int, cell int, n long").groupBy("row", "cell").agg(F.sum("n").alias("n"))
    counts, by_class = np.zeros((PREVIOUS, width)), np.zeros((PREVIOUS, CLASSES))
    for r in mapped.groupBy("row").applyInArrow(_packed, "row int, cells binary, n binary").toLocalIterator():  # PREVIOUS rows of DENSE_IDS + CLASSES cells at most
        cell, n = np.frombuffer(bytes(r["cells"]), "<i2").astype(int), np.frombuffer(bytes(r["n"]), "<i8")
        counts[r["row"], cell[cell >= 0]] = n[cell >= 0]
        by_class[r["row"], -1 - cell[cell < 0]] = n[cell < 0]
    model = build(counts, by_class, unigrams, subwords.starts, subwords.end, last)
    return train_attention(model, gathered.filter("kind = 2")), words, spread, n_docs


def _rows(batches: Iterator[pa.RecordBatch], last: np.ndarray, column: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts by the row of the last id and a cell: the column of a frequent id, and for every id the class c as -1 - c."""
    for b in batches:
        ids, row, n = b["id"].to_numpy(), last[b["last"].to_numpy()], b["n"].to_numpy()
        known = column[ids] >= 0
        yield batch({"row": np.concatenate([row, row[known]]), "cell": np.concatenate([-1 - classes[ids], column[ids[known]]]), "n": np.concatenate([n, n[known]])}, pa.schema([("row", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())]))


def _packed(rows: pa.Table) -> pa.Table:
    return pa.table({"row": rows["row"][:1], "cells": pa.array([rows["cell"].to_numpy().astype("<i2").tobytes()], pa.binary()), "n": pa.array([rows["n"].to_numpy().astype("<i8").tobytes()], pa.binary())})


def score(docs: DataFrame, vocabulary: str | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Null and empty texts are an end alone. Words unseen in training have count 0 in the base and are spelled by the model. Repeated rows count each.
    Without training documents N and V are 0 and the model knows no frequencies.
    """
    path, docs = vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken"), texts(docs)
    model, words, spread, ends = prepare(docs, path)
    tokens, distinct = sum(c * n for c, n in spread.items()) + ends, sum(spread.values()) + (ends > 0)
    least, left = 1 + max(spread, default=0), head_words
    for c in sorted(spread, reverse=True):  # no ranking of all words: every count that fits whole
        if spread[c] > left:
            break
        least, left = c, left - spread[c]
    top = words.filter(F.col("c") >= least).toArrow()
    head, counts = top["word"].cast(pa.binary()).combine_chunks(), top["c"].to_numpy()
    whole = len(head) == sum(spread.values())
    marked = docs.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)
    scored = settle(marked.mapInArrow(partial(_score, path=path, model=model, head=head, counts=counts, ends=ends, whole=whole), "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<string>"), "lm-scored")
    # the words of a partition are hashed: sorting both sides would cost more
    rare = scored.select("row", F.explode("rare").alias("word")).join(words.hint("shuffle_hash"), "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"))
    every = F.lit(float(np.log10(tokens + distinct + 1)))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * every).alias("base_score"), "score",
    )
