import numpy as np
import xxhash

from stratafold.llm import components, simhash
from stratafold.llm.components import connected_components


def brute_fingerprint(text):
    words, lowered = [], "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in lowered.translate({k: " " for k in range(9, 14)}).split(" "):
        if c:
            words.append(c)
    chains = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    h = [xxhash.xxh64(" ".join(c).encode(), seed=42).intdigest() for c in chains]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp) with distinct ids; doc_id to the smallest id reachable."""
    fps = sorted({f for _, f in rows})
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            m = min(label[j] for j in np.flatnonzero(near[i]))
            if m < label[i]:
                label[i], changed = m, True
    at = {f: label[i] for i, f in enumerate(fps)}
    least = {}
    for i, f in rows:
        least[at[f]] = min(i, least.get(at[f], i))
    return {i: least[at[f]] for i, f in rows}


def test_texts_and_components(spark):
    base = "one two three four five six seven eight nine ten " * 8
    texts = [None, "", " \t\n", "A", "a", "a b", "A\x0bB", "x y z", base, base, base.upper(), base + " eleven", base + "\neleven twelve", "été À Ünï " * 9, "w " * 3000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, shard int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = {i: brute_fingerprint(t) for i, t, *_ in rows}
    assert {i: f"{f:016x}" for i, f in want.items()} == {i: r["fingerprint"] for i, r in got.items()}
    assert brute_components(list(want.items())) == {i: r["component_id"] for i, r in got.items()}


def test_index_finds_every_link(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    codes = [int(s) for s in seeds]
    for s in seeds:
        for _ in range(rng.integers(0, 12)):
            c = int(s)
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                c ^= 1 << int(k)
            codes.append(c)
    centre = int(seeds[0])
    codes += [centre ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)]
    codes = sorted(set(codes))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    for rows in (64, 100_000):
        roots = {r["node"] % (1 << 64): r["root"] for r in connected_components(simhash.links(df, 2, rows)).collect()}
        want = brute_components([(c, c) for c in codes])
        groups, found = {}, {}
        for c in codes:
            groups.setdefault(want[c], set()).add(c)
            found.setdefault(roots.get(c, c), set()).add(c)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_long_path_and_empty(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3)], "a long, b long")
    got = connected_components(path).collect()
    assert len(got) == 41 and {r["root"] for r in got} == {0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def test_few_links_write_no_tables(spark, monkeypatch):
    """Few links need no table a round, and make the same components as the rounds."""
    rng = np.random.default_rng(4)
    ends = rng.integers(-(1 << 63), 1 << 63, 900)
    rows = [(int(a), int(b)) for a, b in rng.choice(ends, (700, 2))] + [(5, 5), (None, 3), (3, None)]
    edges = spark.createDataFrame(rows + rows[:50], "a long, b long")
    written, settle = [], components.settle
    monkeypatch.setattr(components, "settle", lambda df, name: written.append(name) or settle(df, name))
    few = connected_components(edges)
    assert few.schema.simpleString() == "struct<node:bigint,root:bigint>" and not written
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    rounds = connected_components(edges)
    assert len(written) > 2 and sorted(map(tuple, few.collect())) == sorted(map(tuple, rounds.collect()))
    assert connected_components(edges.limit(0)).count() == 0


def test_keep_one(spark):
    long = "the quick brown fox jumps over the lazy dog " * 5
    docs = spark.createDataFrame([(1, long, "x"), (2, long, "y"), (3, "other words here in this", "z"), (3, "other words here in this", "z"), (None, long, "n")], "doc_id long, text string, lang string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 3]  # a row without an id is a copy like any
