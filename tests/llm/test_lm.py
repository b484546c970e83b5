import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from stratafold.llm import lm

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_gradients():
    rng = np.random.default_rng(0)
    params = [rng.normal(size=s) for s in ((6, lm.DIM), (6, lm.DIM), (6, lm.DIM), (2 * lm.SPAN,), (lm.DIM, 5))]
    table, now, before, y = rng.normal(size=(6, 5)), *(rng.integers(0, n, (3, lm.SPAN)) for n in (6, 6, 5))
    real, alone = rng.random((3, lm.SPAN)) < 0.8, np.array([False, True, False])
    loss = lambda: lm.gradients(params, table, now, before, alone, y, real, lm.Work(4, True, 5, float))
    _, grads = loss()
    for p, g in zip(params, grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            keep = p[at]
            p[at] = keep + 1e-5
            up = loss()[0]
            p[at] = keep - 1e-5
            down = loss()[0]
            p[at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def toy():
    rng = np.random.default_rng(2)
    size = 200
    unigrams, starts = rng.integers(0, 50, size).astype(float), rng.random(size) < 0.5
    last = rng.integers(0, lm.PREVIOUS, size)
    all_counts = rng.integers(0, 9, (lm.PREVIOUS, size)) * (rng.random((lm.PREVIOUS, size)) < 0.1)
    classes = lm.classes_of(unigrams, starts)
    by_class = np.stack([all_counts[:, classes == k].sum(1) for k in range(lm.CLASSES)], 1).astype(float)
    keep = lm.order_of(unigrams)[: min(lm.DENSE_IDS, size)]
    m = lm.build(all_counts[:, keep].astype(float), by_class, unigrams, starts, size - 1, last)
    m.params = [(rng.normal(size=p.shape) * 0.5).astype(np.float32) for p in m.start()]
    return m, rng, size


def brute(m, seq):
    """One id at a time, from the definition."""
    q, k, v, bias, w = (p.astype(float) for p in m.params)
    out = 0.0
    for t in range(len(seq) - 1):
        begin = max(0, t // lm.SPAN * lm.SPAN - lm.SPAN)
        rows = [m.last[i] for i in seq[begin : t + 1]]
        s = np.array([q[rows[-1]] @ k[r] / math.sqrt(lm.DIM) + bias[len(rows) - 1 - j] for j, r in enumerate(rows)])
        a = np.exp(s) / np.exp(s).sum()
        logits = m.table[rows[-1]] + (a @ v[rows]) @ w
        y = seq[t + 1]
        c = m.classes[y]
        emit = m.after[rows[-1], m.dense[y]] if m.dense[y] >= 0 else m.loose[rows[-1], c] + m.overall[y]
        out += (logits[c] - np.log(np.exp(logits).sum())) / math.log(10) + emit
    return out


@pytest.mark.parametrize("dense", [lm.DENSE_IDS, 60])
def test_blocks_are_the_definition_and_probabilities_sum_to_one(dense, monkeypatch):
    monkeypatch.setattr(lm, "DENSE_IDS", dense)
    m, rng, size = toy()
    assert m.after.shape[1] == min(dense, size)
    sequences = [rng.integers(0, size, n) for n in (2, 17, 18, 33, 34, 120, 2, 49)]
    assert np.allclose(lm.log10_scores(m, sequences, blocks=3), [brute(m, s) for s in sequences], rtol=1e-4)
    start = rng.integers(0, size, 20)
    every = lm.log10_scores(m, [np.append(start, i) for i in range(size)]) - lm.log10_scores(m, [start])[0]
    assert abs((10**every).sum() - 1) < 1e-3


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-5, None, "x", "y", 0), (-6, "Wörd wörd a b", "x", "y", 0), (None, "a b", "x", "y", 0)], docs.schema))
    rows = [(r["doc_id"], tokens(r["text"])) for r in docs.collect()]
    training = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for x in training for w in x)
    n, v = sum(counts.values()) + len(training), len(counts) + 1
    for head in (50, 100_000):
        got = {r["doc_id"]: r for r in lm.score(docs, PATH, head).collect()}
        for i, words in rows:
            r = got[i]
            assert r["n_tokens"] == len(words) + 1 and r["train_tokens"] == n
            assert r["n_known"] == sum(w in counts for w in words) + 1
            want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(training) + 1) / (n + v + 1))
            assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))
    held = [r for r in got.values() if r["held_out"]]
    model, base = (sum(r[k] for r in held) / sum(r["n_tokens"] for r in held) for k in ("score", "base_score"))
    print("per token", model, base)
    assert all(r["score"] < 0 for r in got.values()) and model > 1.15 * base


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_every_id_is_a_target_once(spark):
    m, _, size = toy()
    for n in (2, 16, 17, 32, 33, 34, 48, 49, 50, 120):
        ids = np.array([m.end, *np.arange(1, n - 1) % (size - 2), m.end], "<u2")
        b = lm.blocks_of([ids, ids[:2]], m)
        assert b.y[b.real].tolist() == ids[1:].tolist() + [ids[1]] and b.begins.sum() == 2
        turns = [np.random.default_rng(lm.SEED).permutation(len(b.x))[t :: lm.ROUNDS] for t in range(lm.ROUNDS)]
        assert sorted(np.concatenate(turns).tolist()) == list(range(len(b.x)))
    long = spark.createDataFrame([(1, "word " * 1000)], "doc_id long, text string")
    rows = [bytes(r["ids"]) for r in long.mapInArrow(lambda b: lm._gather(b, PATH), "kind int, word string, key long, n long, ids binary").filter("kind = 2").collect()]
    assert [len(x) // 2 - 1 for x in rows] == [1001]


def chains(spark, n):
    """Texts of a closed vocabulary in which the word two places back, which only attention sees, rules the next."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "cloud", "tiger", "maple", "ember") for b in ("field", "light", "house", "water", "garden")]
    rows = []
    for i in range(n):
        at = [int(rng.integers(0, 30)), int(rng.integers(0, 30))]
        for _ in range(60):
            at.append((at[-2] * 7 + 3) % 30 if rng.random() < 0.9 else int(rng.integers(0, 30)))
        rows.append((i, " ".join(vocabulary[k] for k in at)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")


def per_token(rows, column):
    return sum(r[column] for r in rows) / sum(r["n_tokens"] for r in rows)


def test_attention_carries_the_score(spark, monkeypatch):
    """On held-out texts whose words are all known the model beats its base, and without the attention it loses most of that."""
    docs = chains(spark, 3000)
    held = [r for r in lm.score(docs, PATH).collect() if r["held_out"]]
    assert all(r["n_known"] == r["n_tokens"] for r in held)
    base, whole = per_token(held, "base_score"), per_token(held, "score")
    trained = lm.train_attention

    def without(model, rows):
        model = trained(model, rows)
        model.params[4] = np.zeros_like(model.params[4])
        return model

    monkeypatch.setattr(lm, "train_attention", without)
    plain = per_token([r for r in lm.score(docs, PATH).collect() if r["held_out"]], "score")
    print("per token", whole, plain, base)
    assert whole > 0.8 * base and whole - plain > 0.5 * (whole - base)


def test_edges(spark):
    rows = [(1, None, "k", 1), (2, "", "k", 2), (3, "a b c " * 20_000, "k", 3), (3, "a b c " * 20_000, "k", 3), (None, "a b", "k", 4), (4, "x" * 50_000, "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out int")
    got = lm.score(docs, PATH).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 60_001, 60_001]
    twins = [r["score"] for r in got if r["doc_id"] == 3]
    assert twins[0] == pytest.approx(twins[1], rel=1e-4) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_runs_of_blocks_are_their_blocks():
    """Blocks that follow each other share the keys between them; the gradients are those of each block with its own copy of the block before."""
    m, rng, size = toy()
    b = lm.blocks_of([rng.integers(0, size, n) for n in (300, 40, 90, 200)], m)
    first = np.array([0, 8, 24])
    i = (first[:, None] + np.arange(8)).ravel()
    given = b.x[i], b.begins[i], m.classes[b.y[i]], b.real[i]
    params = [p.astype(float) for p in m.params]
    results = []
    for before in (b.x[np.maximum(first - 1, 0)], b.x[np.maximum(i - 1, 0)]):
        results.append(lm.gradients(params, m.table.astype(float), given[0], before, *given[1:], lm.Work(len(i), True, dtype=float)))
    assert results[0][0] == pytest.approx(results[1][0])
    for p, q in zip(results[0][1], results[1][1], strict=True):
        assert p.any() and np.allclose(p, q, rtol=1e-9, atol=1e-12)


def test_chunks_are_spelled_by_their_distinct_words():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    signs = ["a", "B", "Éz", " ", " ", "\n", "\t\x0b", "　", "\x1c", "\x85", "12", "ß"]
    texts = ["", *("".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(200)), "a  b "]
    subwords = lm.Subwords(PATH)
    words, places, ids, ends = subwords.read(pa.array(["cut off", *texts])[1:])
    assert words.to_pylist() == [w.encode() for t in texts for w in tokens(t)] and len(ends) == len(texts) + 1
    known = [None, *words.dictionary.to_pylist()]
    stops = np.flatnonzero(places == 0)
    for t, i, j, a, z in zip(texts, ends[:-1], ends[1:], stops[:-1], stops[1:], strict=True):
        assert [known[p] for p in places[a + 1 : z]] == [w.encode() for w in tokens(t)]
        assert ids[i : j + 1].tolist() == [subwords.end, *(k for w in tokens(t) for k in subwords.encoding.encode_ordinary(" " + w)), subwords.end]


def test_graphs_are_the_same_arithmetic():
    """Gradients and class scores by onnxruntime are those of numpy in 64 bits, also where a run begins a text, is short or has scores of attention beyond 60."""
    graphs = pytest.importorskip("stratafold.llm.graphs")
    m, rng, size = toy()
    b = lm.blocks_of([rng.integers(0, size, n) for n in (300, 40, 90, 200)], m)
    first = np.array([0, 8, 24])
    i = (first[:, None] + np.arange(8)).ravel()
    before, classes = b.x[np.maximum(first - 1, 0)], m.classes[b.y]
    assert b.begins[i].sum() > 1 and not b.real[i].all()
    want = lm.gradients([p.astype(float) for p in m.params], m.table.astype(float), b.x[i], before, b.begins[i], classes[i], b.real[i], lm.Work(len(i), True, dtype=float))[1]
    got = lm.gradients_of(m)(m.params, b.x[i], before, b.begins[i], classes[i], b.real[i])
    for p, q in zip(want, got, strict=True):
        assert p.any() and p.shape == q.shape and q.dtype == np.float32 and abs(p - q).max() < 1e-5 * abs(p).max()
    assert isinstance(lm.class_scores_of(m, 8), graphs.Scores)
    sequences = [rng.integers(0, size, n) for n in (2, 17, 33, 120, 49)]
    assert np.allclose(lm.log10_scores(m, sequences, blocks=3), [brute(m, s) for s in sequences], rtol=1e-4)
    m.params[0], m.params[1] = m.params[0] * 8, m.params[1] * 8
    assert np.allclose(lm.log10_scores(m, sequences), [brute(m, s) for s in sequences], rtol=1e-4)


def test_without_onnxruntime_the_results_are_the_same(monkeypatch):
    m, rng, size = toy()
    sequences = [rng.integers(0, size, n) for n in (2, 17, 120, 49)]
    b = lm.blocks_of(sequences, m)
    given = b.x[:4], b.x[:1], b.begins[:4], m.classes[b.y[:4]], b.real[:4]
    scores, grads = lm.log10_scores(m, sequences), lm.gradients_of(m)(m.params, *given)
    monkeypatch.setattr(lm, "_graphs", lambda: None)
    assert np.allclose(lm.log10_scores(m, sequences), scores, rtol=1e-5)
    for p, q in zip(lm.gradients_of(m)(m.params, *given), grads, strict=True):
        assert np.allclose(p, q, rtol=1e-3, atol=1e-6)
