import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratafold.llm import packing


def brute_best_fit(lengths, capacity):
    """Bins' remaining capacities, one item at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r, i) for i, r in enumerate(rooms) if r >= n) if any(r >= n for r in rooms) else None
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[best[1]] -= n
    return sorted(rooms)


def rooms_of_plan(counts, capacity):
    runs = sorted(packing.plan(counts, capacity))
    left, taken = defaultdict(lambda: capacity), set()
    for k, (n, rank, first, each, offset) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
        for i in range(end - rank):
            b, at = first + i // each, offset + i % each * n
            left[b] -= n
            for t in range(at, at + n):
                assert (b, t) not in taken
                taken.add((b, t))
    assert all({(b, t) for t in range(capacity - r)} <= taken for b, r in left.items())
    return sorted(left.values())


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 7, 16, 50, 64):
        for n in (0, 1, 5, 60, 300):
            lengths = [min(capacity, max(1, int(rng.expovariate(4 / capacity)) + 1)) for _ in range(n)]
            assert rooms_of_plan(Counter(lengths), capacity) == brute_best_fit(lengths, capacity)


def test_words_are_the_library_s():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own, rng = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    parts = ["th", "ER", "tion", "é", "É", "ß", "ñ", "e", "lo", "Wei", "qu", "'s", "'LL", "1", "...", "!!", "|", "<|endoftext|>", "\u0301", "İ", "Σ", "日", "😀", "\xa0", "\x1c", "_"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(5000)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzÀÿ") for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)] + ["", "<|endoftext|>"]
    for text, got in zip(texts, own.texts([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "  ", "Hello, WORLD! it's 2024", "éa <|endoftext|>x", "\x1ca\x85b c", "word " * 5000, "日本語 текст 😀", "dup", "dup", "x" * 9000]
    rows = [(i, s, 7) for i, s in enumerate(texts)] + [(8, "dup", 7), (None, "no id", 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, s in enumerate(texts):
        ids = t.encode(s or "", add_special_tokens=False).ids + [0]
        want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == sorted(want * (2 if i == 8 else 1))
    assert len(by[None]) == 1
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in ends.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(2048 - sum(n for _, n in x) for x in ends.values()) == brute_best_fit([r["length"] for r in got], 2048)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
