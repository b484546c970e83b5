import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.llm import toxicity


def brute_segments(s):
    """Ruzzo and Tompa's recursion: the best segment, then what is left and right of it."""
    def part(a, b):
        best = max(((sum(s[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*part(a, i), (i, j, best[0]), *part(j, b)]
    return part(0, len(s))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -2.25, -1.5, -0.5, 0.75, 1.0625, 2.125, 5.03125]), max_size=14))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    want = brute_segments(scores)
    assert sum(s for *_, s in got) == sum(s for *_, s in want)
    assert [s for *_, s in got] == [s for *_, s in want]


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).toPandas()
    truth = labels.toPandas().set_index("doc_id")["toxic"]
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    held = out[out.held_out & out.doc_id.isin(truth.index)]
    y = truth[held.doc_id].to_numpy()
    assert held.predicted[y == 1].mean() > 0.85 and held.predicted[y == 0].mean() < 0.03
    for r in toxicity.passages(docs.limit(2000), model).limit(20).collect():
        text = docs.filter(f"doc_id = {r['doc_id']}").first()["text"]
        assert text[r["start"] : r["end"]] == r["text"]


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (3, "12 !! ##", 0), (4, "vile word " * 9000, 1), (None, "vile", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, empty).collect()
    assert len(got) == 6 and all(r["predicted"] == 0 for r in got)
    assert toxicity.score(docs.limit(0), empty).count() == 0
    assert toxicity.passages(docs, empty).count() == 0
    assert toxicity.entries("Été") == ["été"] and toxicity.entries("abcdef") == ["abcdef", "abcd*", "abcde*", "abcdef*"]


def test_a_second_passage_of_the_same_words_counts():
    bad = ["vile", "foul", "nasty", "gross"]
    scorer, one = toxicity.Scorer(toxicity.Model({w: (2.0, 9.0) for w in bad})), 2.0 - toxicity.DRIFT
    passage, calm = " ".join(bad), "calm " * 60
    assert [s for *_, s in scorer.scan(f"{passage} {calm} {passage}")[0]] == [4 * one] * 2
    assert max(s for *_, s in scorer.scan(f" {calm} ".join(bad) + f" {calm} {passage}")[0]) == 4 * one
    assert max(s for *_, s in scorer.scan("vile " * 50)[0]) == one
