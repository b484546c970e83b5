import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratafold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return bpe.ByteBPE(PATH), t


CASES = ["", " ", "  ", " a", "a  b", "a \n b", "\n\n x", "x \n", "it's they'RE 'tis 's", "naïve café", "日本語 テキスト", "😀😀 ok", "a b  c", "a   b", "\x1c x\x1dy", "x" * 3000,
         "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|><|endoftext|>\n", "<|endoftext", "12 345 6.7!!", "\t\ttabs\r\nend\r", "éá", "' s", "Ünï " * 40, "\x00\x01", "a\u0085b", "　x"]


def test_cases(both):
    own, library = both
    for text in CASES:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, repr(text)
        assert own.decode(want).decode() == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sre 12 \t\n\r\x0b\x1c\x85\xa0é日😀.!<|", max_size=40))
def test_any_text(both, text):
    own, library = both
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_table(spark, both, tables):
    docs = tables["documents"].unionByName(spark.createDataFrame([(-1, None, "x", "y", 1), (None, "a", "x", "y", 1)], tables["documents"].schema))
    got = sorted(map(tuple, bpe.digests(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = both[1].encode(r["text"] or "", add_special_tokens=False).ids
        text = both[1].decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_a_word_is_merged_once(monkeypatch):
    met, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda symbols, merges: met.append(1) or merge(symbols, merges))
    own = bpe.ByteBPE(PATH)
    text = "".join(f"x{a}{e}" for a in (" strange", " unheard") for e in ("", ".", ",", "!", "?", ";"))
    assert own.decode(own.encode(text)) == text.encode()
    assert len(met) == len(set(own.pre_tokens(text)))
