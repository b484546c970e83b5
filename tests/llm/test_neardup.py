import random

import corpus_pipeline
from stratafold.llm import neardup, simhash


def brute_sets(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_kept(rows):
    """rows: (doc_id, text); one row of each component."""
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = {}
    for r, row in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(row)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    return sorted((min(g, key=key) for g in groups.values()), key=key)


def edited(words, at):
    return " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))


def test_edited_copies_go(spark):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        words = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(200)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, edited(words, {40, 120})), (10 * k + 2, edited(words, {i * 12 for i in range(15)}))]
    rows += [(5, rows[0][1]), (5, "another text under the same id as a copy"), (None, rows[3][1]), (None, "alone " * 9), (None, "alone " * 9), (901, None), (902, " "), (903, "a b"), (904, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = brute_kept(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all((10 * k + 1) not in {i for i, _ in got} for k in range(30))  # two of 200 words edited
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_no_text_is_lost_and_columns_pass(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "x", 1), (1, "one two three four five six", "x", 2), (2, "alpha beta gamma delta epsilon zeta", "y", 3), (2, "one two three four five six", "y", 4), (3, "w " * 60_000, "z", 5), (4, "w " * 60_000, "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __copy_of string, fp int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["fp"] for r in kept.collect()) == [1, 2, 5]


def test_links_that_only_bands_propose(spark):
    """Pairs of likeness 0.8 and more whose fingerprints lie far apart are found; the index alone would miss them."""
    rng = random.Random(8)
    rows, far = [], 0
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, {30, 75, 120}))]
        a, b = (neardup.majority(neardup.shingles(t.encode())) for _, t in rows[-2:])
        far += (a ^ b).bit_count() > simhash.MAX_BITS
    assert far > 30
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(60)}


def test_a_shared_passage_is_not_paired_and_loses_no_link(spark):
    """Unlike texts of one bucket that share a passage make few pairs; the like ones among them are all found."""
    rng = random.Random(5)
    passage, rows = [f"p{i}" for i in range(60)], []
    for k in range(300):
        own = [f"k{rng.randrange(10_000)}" for _ in range(rng.randrange(8, 30))]
        rows.append((10 * k, " ".join(passage + own)))
        if k % 10 == 0:
            rows.append((10 * k + 1, " ".join([*passage, *own[:-1], "other"])))
    sets = {i: neardup.shingles(t.encode()) for i, t in rows}
    found = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "copy long, found binary")
    named = spark.createDataFrame([(key, i, i) for key in (1, 2) for i in sets], "key long, copy long, root long")
    got = {(r["a"], r["b"]) for r in neardup.apart(named, found).collect()}
    shared = lambda x, y: len(set(x.tolist()) & set(y.tolist()))
    want = {(i, j) for i in sets for j in sets if i < j and (n := shared(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    assert len(want) >= 30 and want <= got and len(got) < len(want) + len(sets)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == sorted(brute_kept(rows))
