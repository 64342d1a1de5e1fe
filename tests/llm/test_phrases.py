"""Phrases against a plain count, and the perfect hash that counts them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyrill.llm import packing, perfect_hash, phrases
from tallyrill.llm.shingles import LONG, PIECE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, longest=4, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in found.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            over = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not over:
                rest.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rest)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, TEXT int").repartition(3)
    return sorted(map(tuple, phrases.mine(df, **options).collect()))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "a", "mat", "ÀÉ", "漢字", "x　y", "it's", "New", "York"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(40)))
        out.append((text, rng.choice(["en", "fr", None, "und"])))
    return out + [(None, "en"), ("", None), (" \t.", "de"), ("one, two. three", "es")]


@pytest.mark.parametrize("least", [2, 10])
def test_equals_a_plain_count(spark, least):
    rows = corpus()
    got = mined(spark, rows, least=least, top=50)
    assert got == plain(rows, least=least, top=50) and got


def test_copies_empty_tables_and_no_candidates(spark):
    assert mined(spark, []) == [] and mined(spark, [("a b", "en"), (None, None)]) == []
    rows = [("many words here, MANY words here", "en")] * 40 + [("many words", "en")] * 7
    assert mined(spark, rows) == plain(rows)


def test_several_shards_and_long_texts(spark, monkeypatch):
    rows = corpus(200, 7) + [(" ".join(random.Random(2).choices("abcdefg", k=20_000)), "en"), ("w" * (PIECE + 9) + " b c " * 40 + "w" * (PIECE + 9), "en")]
    want = plain(rows, least=8, top=60)
    monkeypatch.setattr(phrases, "KEYS", 300)
    monkeypatch.setattr(phrases, "PLACES", 20_000)
    assert mined(spark, rows, least=8, top=60) == want


@pytest.mark.parametrize("text", ["", " ", "a", "a b,c", ",a", "a,", "b" * (PIECE + 5), "a " * LONG, "a\n" + "b" * (PIECE + 5) + "\nc d " + "x" * LONG + ", e", ("ab " * 99 + "\n") * 9000])
def test_tokens_of_texts_of_any_length(text):
    raw = b"\n" + text.encode().translate(phrases.FOLD) + b"\n"
    got = phrases.Tokens(raw)
    words = [raw[a:b] for a, b in zip(got.start.tolist(), got.end.tolist(), strict=True)]
    want = [(w, i == 0) for p in raw.split(b"\n") for i, w in enumerate(p.split())]
    assert words == [w for w, _ in want] and got.breaks.tolist() == [b for _, b in want]
    assert len(set(words)) == len(set(got.hashes.tolist()))


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1))
        table = perfect_hash.PerfectHash(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        assert (table.slots(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        perfect_hash.PerfectHash(np.array([5, 5], np.uint64))


def test_packed_blocks_come_back():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 500, np.uint64))
    counts = np.arange(500) * 900
    assert (packing.keys_of(packing.packed_keys(keys)) == keys).all() and (packing.counts_of(packing.packed_counts(counts), 500) == counts).all()
