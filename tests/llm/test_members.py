import random
import time

import pytest

from stratafold.llm import members, simhash


@pytest.mark.parametrize("words", [4, members.WORDS])
def test_rows_by_keys(spark, monkeypatch, words):
    """Also where the words are too few to tell keys apart."""
    monkeypatch.setattr(members, "WORDS", words)
    rows = spark.createDataFrame([(k, str(k)) for k in range(-500, 500)] + [(7, "again")], "`a key` long, text string")
    for of in ([], range(0, 300, 3), range(-600, 600)):
        keys = spark.createDataFrame([(k,) for k in of], "`a key` long")
        held = [r["a key"] for r in members.possible(rows, keys, "a key").collect()]
        assert sorted(k for k in held if k in set(of)) == sorted(k for k in (*range(-500, 500), 7) if k in set(of))
        assert len(of) != 100 or words == 4 or len(held) < 120
        left = members.without(rows, keys, "a key")
        assert left.columns == rows.columns
        assert sorted(r["a key"] for r in left.collect()) == sorted(k for k in (*range(-500, 500), 7) if k not in set(of))


def test_texts_without_company_stay_in_place(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.randbytes(8).hex() for _ in range(1000))) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(9)] + [(2000, rows[20][1] + " more"), (None, rows[30][1]), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    time.sleep(1)
    assert sorted(kept) == sorted(rows[:300])
    assert moved() - before < 0.5 * sum(len(t) for _, t in rows)  # twice and more when every text went to its group


def test_of_a_group_that_shares_its_least_id_the_first_text_stays(spark):
    words = [f"w{k}" for k in range(200)]
    near = [" ".join([*words, f"end{k}"]) for k in range(6)]
    alone = [" ".join(f"{c}{k}" for k in range(50)) for c in "xyz"]
    rows = [(4, near[3]), (4, near[1]), (4, near[2]), (9, near[0]), (None, near[0]), (4, near[1]), (None, alone[0] + " b"), (None, alone[0] + " a"), (4, alone[1]), (None, alone[2])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(4, near[1]), (None, alone[0] + " a"), (4, alone[1]), (None, alone[2])]))
