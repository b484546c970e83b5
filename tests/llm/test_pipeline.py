from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratafold.llm import quality, rules
from tests.llm.test_packing import brute_best_fit
from tests.llm.test_neardup import brute_kept

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "best_fit_packing"]
    steps, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.settle(stage(spark, now, DIR), f"test-{name}")
        steps.append(now)
    for df in steps[:3]:
        assert df.columns == docs.columns

    field = rules.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {i for i, t in texts.items() if rules.judge(t.encode(), field)[-1]}
    assert {r["doc_id"] for r in steps[0].collect()} == first

    stats = quality.statistics(steps[0])
    model = quality.train(stats, labels)
    rows = stats.collect()
    score = model.score(np.array([r["stats"] for r in rows]))
    second = {r["doc_id"] for r, s in zip(rows, score, strict=True) if s >= quality.THRESHOLD}
    assert {r["doc_id"] for r in steps[1].collect()} == second

    third = {i for i, _ in brute_kept([(i, texts[i]) for i in second])}
    assert {r["doc_id"]: r["text"] for r in steps[2].collect()} == {i: texts[i] for i in third}

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in third}
    pieces, bins = defaultdict(int), defaultdict(int)
    for r in steps[3].collect():
        pieces[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]] += r["length"]
    assert pieces == lengths
    every = [n for total in lengths.values() for n in [2048] * (total // 2048) + [total % 2048] * (total % 2048 > 0)]
    assert sorted(2048 - n for n in bins.values()) == brute_best_fit(every, 2048)
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()} & set(texts)
    assert len(good & second) >= 0.97 * len(good - {i for i in good if rules.judge(texts[i].encode(), field)[5]})


def run_over(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_edges(spark, tables, tmp_path):
    """Nulls, repeated rows, long texts and clashing columns; an empty table gives an empty result."""
    some = tables["documents"].orderBy("doc_id").limit(60)
    good = tables["labels"].filter("quality = 1 and toxic = 0").select("doc_id")
    long = "\n".join(sorted({r["text"] for r in tables["documents"].join(good, "doc_id").filter("length(text) > 1500").collect()}))
    rows = [(1001, None, 1, "x"), (None, None, 1, "x"), (1002, "", 1, "x"), (1003, long, 1, "x"), (1004, long, 1, "x"), (None, "a text with words enough " * 2 + "to be kept by all of the rules that stand before it, in one line.", 1, "x")]
    more = spark.createDataFrame(rows, "doc_id long, text string, length int, __rank string")
    docs = some.select("doc_id", "text", F.lit(1).alias("length"), F.lit("r").alias("__rank")).unionByName(more).unionByName(some.limit(5).select("doc_id", "text", F.lit(2).alias("length"), F.lit("r").alias("__rank")))
    got = run_over(spark, tmp_path / "a", docs, tables["labels"]).collect()
    pieces = [(r["doc_id"], r["piece"]) for r in got]
    assert len(set(pieces)) == len(pieces) and {1001, 1002}.isdisjoint({i for i, _ in pieces})
    assert sum(r["length"] for r in got if r["doc_id"] == 1003) > 10_000 and 1004 not in {i for i, _ in pieces}
    assert run_over(spark, tmp_path / "b", docs.limit(0), tables["labels"].limit(0)).count() == 0
