import hashlib
import itertools

import regex

from stratafold.llm import spotsigs


def brute(text):
    """Signatures as tuples: anchor and the next content words, of which the last may be missing."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    common, found = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        chain = list(itertools.islice((x for x in words[i + 1 :] if x not in common), 2))
        if w in common and chain:
            found.add((w, *chain))
    return found or {tuple(words[i : i + 3]) for i in range(len(words))} or {("whole", text or "")}


def likeness(a, b):
    return len(a & b) / len(a | b)


TEXTS = ["The cat sat on the mat and the dog lay in a box by the door of the house", None, "", " !! ", "of the", "alpha beta gamma delta", "The end", "der Hund und die Katze im Haus", "the x " * 4000, "é of ü, à la carte; it's 12 of 24"]


def test_edits(spark):
    rows = [(10 * i + 3, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[0], "y"), (None, "the last of all", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = sorted(spotsigs.edits(docs).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for k, (r, (_, text, _)) in enumerate(zip(got, order, strict=True)):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(brute(text), brute(edited))) < 1e-12, text
        assert abs(r["near_next"] - likeness(brute(text), brute(after))) < 1e-12
        for other, (_, t, _) in zip(got, order, strict=True):
            assert (r["fingerprint"] == other["fingerprint"]) == (brute(text) == brute(t))
            assert (r["edited_fingerprint"] == other["fingerprint"]) == (brute(edited) == brute(t))


def test_whole_table_and_plan(spark, tables):
    df = spotsigs.edits(tables["documents"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan.split("BroadcastExchange")[0]
    assert plan.count("shufflepartitionidpassthrough") == 1
    assert df.count() == tables["documents"].count()
    alone = spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")
    assert spotsigs.edits(alone).first()["near_next"] == 1.0
    assert spotsigs.edits(alone.limit(0)).count() == 0


def test_near_duplicates(spark, tables):
    members, pairs = spotsigs.near_duplicates(tables["documents"])
    classes = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = {r["doc_id"]: brute(r["text"]) for r in tables["documents"].collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    assert classes == {i: first[frozenset(s)] for i, s in sets.items()}
    reps = sorted(set(classes.values()))
    want = {(a, b) for a, b in itertools.combinations(reps, 2) if likeness(sets[a], sets[b]) >= 0.8}
    got = {(r["left"], r["right"]): r["likeness"] for r in pairs.collect()}
    assert set(got) == want and all(abs(v - likeness(sets[a], sets[b])) < 1e-12 for (a, b), v in got.items())
