import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked), n < 20 or 100 * len(marked) > 30 * n


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #|é\n\t\r\x0b\x1c 😀", max_size=120))
def test_base_counts(text):
    assert rules.judge(text.encode(), rules.LineField.prior())[:6] == brute_base(text)


def test_repeats():
    words = [f"w{i}" for i in range(30)]
    for ws in (words + words[:10], ["a"] * 9, ["a"] * 8, words + ["x"] + words, [], words):
        assert rules.judge(" ".join(ws).encode(), rules.LineField.prior())[4] == brute_base(" ".join(ws))[4]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        f = rules.LineField(rng.normal(size=len(rules.FEATURES)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, len(rules.FEATURES)))
        score = lambda p: sum(s * (x[i] @ f.weights) for i, s in enumerate(p)) + sum(f.pairs[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert score(tuple(map(int, f.boilerplate(x)))) >= max(map(score, itertools.product((0, 1), repeat=n))) - 1e-9


def test_gradient():
    rng = np.random.default_rng(1)
    f = len(rules.FEATURES)
    xs, mask, gold = rng.normal(size=(3, 4, f)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], float), np.array([1.0, 0, 1])
    xs *= mask[..., None]
    share, theta = np.array([0.3, 0.2, 0.5]), rng.normal(size=f + 4)
    # each line has its own share only if all lines of a chunk have the same, so that the likelihood is that of the chunk
    def likelihood(t):
        w, pairs, out = t[:f], t[f:].reshape(2, 2), 0.0
        for x, m, y, s in zip(xs, mask, gold, share, strict=True):
            n = int(m.sum())
            score = lambda p: sum(k * (x[i] @ w) for i, k in enumerate(p)) + sum(pairs[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            out += s * (score((int(y),) * n) - np.logaddexp.reduce([score(p) for p in itertools.product((0, 1), repeat=n)]))
        return out
    got = rules.LineField._gradient(theta, xs, mask, gold, share, f)
    for k in range(f + 4):
        d = np.zeros(f + 4)
        d[k] = 1e-5
        assert abs((likelihood(theta + d) - likelihood(theta - d)) / 2e-5 - got[k]) < 1e-4


def test_on_tables(spark, tables):
    field = rules.train(tables["documents"], tables["labels"])
    got = {r["doc_id"]: r for r in rules.annotate(tables["documents"], field).collect()}
    rows = {r["doc_id"]: r["text"] for r in tables["documents"].select("doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, t in itertools.islice(rows.items(), 150):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(t)
    quality = {r["doc_id"]: r["quality"] for r in tables["labels"].collect()}
    good = [got[i]["kept"] for i, q in quality.items() if q == 1 and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, q in quality.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    kept = rules.keep(tables["documents"], field)
    assert kept.columns == tables["documents"].columns
    assert kept.count() == sum(r["kept"] for r in got.values())


def test_edges(spark):
    prior = rules.LineField.prior()
    rows = [(1, None, "k"), (2, "", "k"), (3, "a b c\n" * 3000, "k"), (3, "a b c\n" * 3000, "k"), (None, "x " * 50, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert [r["kept"] for r in rules.annotate(docs, prior).collect()] == [False] * 5
    assert rules.keep(docs, prior).columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert np.array_equal(rules.train(docs, none).weights, prior.weights)
    assert rules.annotate(docs.limit(0), prior).count() == 0


def test_lines_are_marked_one_by_one():
    """Menus planted among sentences, from labels of whole documents alone."""
    rng = np.random.default_rng(6)
    nouns = ["river", "house", "garden", "window", "letter", "morning", "teacher", "village", "market", "winter", "story", "bridge"]
    sentence = lambda: "The " + " ".join(rng.choice(nouns, rng.integers(6, 12))) + " was there."
    menu = lambda: " | ".join(w.upper() for w in rng.choice(nouns, rng.integers(3, 6)))

    def mixed(low):
        flags, now = [], bool(rng.random() < 0.5)
        for _ in range(24):
            flags.append(now)
            now = now != (rng.random() < 0.15)
        flags = [(not f if rng.random() < 0.8 and f != low else f) for f in flags] if (np.mean(flags) >= 0.5) != low else flags
        return flags, "\n".join(menu() if f else sentence() for f in flags)

    def run_of(low):
        flags, text = mixed(low)
        x, words, _ = rules.line_table(text.encode())
        return np.array(flags), text, (x, words, int(low))

    field = rules.LineField.learn([run_of(k % 3 == 0)[2] for k in range(150)])
    right = lines = between = 0
    for k in range(60):
        flags, text, (x, words, _) = run_of(k % 3 == 0)
        found = field.boilerplate(x)
        right, lines = right + int((found == flags).sum()), lines + len(flags)
        share = rules.judge(text.encode(), field)[6]
        assert share == pytest.approx(words[~found].sum() / words.sum())
        between += 0 < share < 1
    assert right > 0.97 * lines and between > 50


def test_explained_labels_agree_with_the_document():
    rng = np.random.default_rng(2)
    field = rules.LineField.prior()
    for _ in range(40):
        x, words = rng.normal(size=(rng.integers(1, 12), len(rules.FEATURES))), rng.integers(1, 20, 12)
        words = words[: len(x)]
        for low in (0, 1):
            found = field.explain(x, words, low)
            assert ((found * words).sum() / words.sum() >= 0.5) == bool(low)
