import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.llm import bpe, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(alphabet="ab'sre 12 \t\n\r\x0b\x1c\xa0é日.!", max_size=60) | st.text(alphabet="ab \n", max_size=400) | st.just("x <|endoftext|>\n y")


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(PATH)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 400), st.integers(0, 30), TEXT), max_size=5))
def test_any_edits(own, text, edits):
    old, tokencount.LEAF = tokencount.LEAF, 3
    try:
        counted = tokencount.CountedText(text, tokencount.Counter(own))
        for at, gone, come in edits:
            at = min(at, len(text))
            text = text[:at] + come + text[at + gone :]
            counted.edit(at, at + gone, come)
            assert counted.text == text
            assert counted.tokens == len(own.encode(text))
            assert sum(map(sum, counted.lengths)) == len(text)
    finally:
        tokencount.LEAF = old


def test_edits_are_local(own):
    text = "some words in a row, and more of them. " * 2000
    counted = tokencount.CountedText(text, tokencount.Counter(own))
    assert counted.edit(40_000, 40_003, "new") < 12
    assert counted.edit(0, 1, "S") < 6 and counted.edit(len(text), len(text), "!") < 6
    assert counted.tokens == len(own.encode(counted.text))
    assert counted.prefix_tokens(0) == 0 and counted.prefix_tokens(len(text) + 9) == counted.tokens


def test_table(spark, own, tables):
    docs = tables["documents"].unionByName(spark.createDataFrame([(-1, None, "x", "y", 1), (None, "a", "x", "y", 1)], tables["documents"].schema))
    got = {r["doc_id"]: r for r in tokencount.edited_counts(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        assert got[r["doc_id"]]["n_tokens"] == len(own.encode(text))
        for share, gone, come in tokencount.EDITS:
            at = int(len(text) * share)
            text = text[:at] + come + text[at + gone :]
        assert got[r["doc_id"]]["edited_tokens"] == len(own.encode(text))
    assert tokencount.edited_counts(docs.limit(0)).count() == 0


def test_edges(spark, own):
    long = "a word or two, 日本 and more\n" * 40_000
    rows = [(1, long, "k", 1), (1, long, "k", 1), (2, "", "k", 2), (2, None, "k", 2), (None, "twin", "k", 3), (None, "twin", "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, edited_tokens int")
    got = tokencount.edited_counts(docs).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(own.encode(t or "")) for _, t, *_ in rows)
    assert {r["reencoded_units"] for r in got if r["doc_id"] == 1} == {next(r["reencoded_units"] for r in got if r["doc_id"] == 1)}
    assert all(r["reencoded_units"] < 60 for r in got)


def test_an_edit_does_not_read_the_text(own, monkeypatch):
    """Edits of a text of millions of characters look at some thousands of them."""
    text = "some words in a row, and more of them. " * 50_000
    counted = tokencount.CountedText(text, tokencount.Counter(own))
    read = []
    plain, chunk = tokencount.Counter.plain, tokencount.CountedText.slice
    monkeypatch.setattr(tokencount.Counter, "plain", lambda self, t: read.append(len(t)) or plain(self, t))
    monkeypatch.setattr(tokencount.CountedText, "slice", lambda self, a, b: read.append(len(x := chunk(self, a, b))) or x)
    for k in range(100):
        counted.edit(k * 15_000, k * 15_000 + 3, " <|endof new")
    assert sum(read) < 100 * 2000
