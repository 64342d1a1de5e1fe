"""The toxicity models against a textbook recursion over Python counts, and in shards."""

import math

import numpy as np
import pytest

from tallyrill.llm import ngram, toxicity
from tallyrill.llm.decontaminate import FOLD

DOC = "doc_id long, text string, flag boolean, WORDS string"
LONG_ONE = "thisveryverylongwordendswithanabominableinsultinit"
TEXTS = [(LONG_ONE, True), ("y" + LONG_ONE + " abba cab", True), ("thisveryverylongwordendswithwishesofgoodhealth abba cab dab", False), ("Abra kadabra", True), ("abra abba, abra!", True), ("cab drab", False), ("abba cab dab", False), ("été drab", False), (None, True), ("", False)]


D, R = toxicity.DEPTH, toxicity.RUN


def words_of(text):
    return (text or "").lower().encode().translate(FOLD).split()


def parts_of(text):
    """The beginnings of each word, and of each run beyond its first ``D`` bytes (marked)."""
    out = []
    for w in words_of(text):
        whole = w + b" "
        out.append(tuple(whole[:k] for k in range(1, min(len(whole), D) + 1)))
        out += [tuple(("run", whole[at : at + k]) for k in range(1, R + 1)) for at in range(D - R + 1, len(whole) - R + 1)]
    return out


def context(b):
    return ("run", b[1][:-1]) if isinstance(b, tuple) else b[:-1]


def gram(b):
    return tuple((b"\0" * toxicity.ORDER + (b[1] if isinstance(b, tuple) else b))[-toxicity.ORDER :])


def brute_pairs(texts):
    """Ratios of pairs of words in a row."""
    counts = [{}, {}]
    for text, flag in texts:
        w = words_of(text)
        for p in set(zip(w, w[1:], strict=False)):
            at = counts[0 if flag else 1]
            at[p] = at.get(p, 0) + 1
    every = set(counts[0]) | set(counts[1])
    cuts = [ngram._discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4))) for c in counts]

    def ratio(p):
        if sum(c.get(p, 0) for c in counts) < 2:
            return 0.0
        below = sum(q[1] == p[1] for q in every) / len(every)
        out = []
        for c, d in zip(counts, cuts, strict=True):
            follow = [n for q, n in c.items() if q[0] == p[0]]
            n, free = c.get(p, 0), sum(d[min(n, 3) - 1] for n in follow) / sum(follow) if follow else 1.0
            out.append((max(n - d[min(n, 3) - 1], 0) / sum(follow) if n else 0.0) + free * below)
        return min(math.log(out[0] / out[1]), toxicity.LIMIT)

    return ratio


def brute_ratios(texts):
    """A function from a word to its ratio."""
    counts = [{}, {}]
    for text, flag in texts:
        for part in set(parts_of(text)):
            for b in dict.fromkeys(part):
                at = counts[0 if flag else 1]
                at[b] = at.get(b, 0) + 1
    everything = set(counts[0]) | set(counts[1])
    cuts = [ngram._discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4))) for c in counts]
    grams = {}
    for b in everything:
        g = gram(b)
        grams[g] = grams.get(g, 0) + counts[0].get(b, 0) + counts[1].get(b, 0)
    levels = {toxicity.ORDER: grams}
    for k in range(toxicity.ORDER - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    lower = {k: ngram._discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4))) for k, c in levels.items()}

    def below(g):
        if not g:
            return 1 / 256
        follow = [n for h, n in levels[len(g)].items() if h[:-1] == g[:-1]]
        if not follow:
            return below(g[1:])
        n, d = levels[len(g)].get(g, 0), lower[len(g)]
        return (max(n - d[min(n, 3) - 1], 0) / sum(follow) if n else 0) + sum(d[min(x, 3) - 1] for x in follow) / sum(follow) * below(g[1:])

    def parts(c, d, before):
        follow = [n for b, n in c.items() if context(b) == before]
        return sum(follow), sum(d[min(n, 3) - 1] for n in follow) / sum(follow) if follow else 1.0

    def ratio(part):
        out = 0.0
        for b in part:
            total, free = zip(*(parts(c, d, context(b)) for c, d in zip(counts, cuts, strict=True)), strict=True)
            run = isinstance(b, tuple)
            if b not in everything or (run and sum(c.get(b, 0) for c in counts) < 2):
                return min(out + (math.log(free[0] / free[1]) if len(b[1] if run else b) > 1 else 0.0), toxicity.LIMIT)
            p = below(gram(b))
            own = [(max(c.get(b, 0) - (d[min(c[b], 3) - 1] if b in c else 0), 0) / t if t else 0) + f * p for c, d, t, f in zip(counts, cuts, total, free, strict=True)]
            out += math.log(own[0] / own[1])
        return min(out, toxicity.LIMIT)

    return ratio


@pytest.mark.parametrize("bound", [10**6, 15])
def test_ratios_against_the_textbook(spark, bound):
    rows = spark.createDataFrame([(i, t, f, "x") for i, (t, f) in enumerate(TEXTS)], DOC)
    detector = toxicity.Detector.__new__(toxicity.Detector)
    detector.model, detector.pairs = toxicity.model(toxicity.counted(rows)), toxicity.pair_model(toxicity.counted_pairs(rows))
    detector.shards = max(1, -(-detector.model.count() // bound))
    ratio, pair = brute_ratios(TEXTS), brute_pairs(TEXTS)
    probes = ["abra kadab zebra", "cab", "ÉTÉ abba dab drab abra", "", None, "... !", "abra " * 3, "k" * 40, "x" + LONG_ONE + " abba cab", "abba cab " * 3]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate([*probes, probes[0]])], DOC)
    got = {}
    for r in detector.ratios(df, "text").collect():
        got.setdefault(r["doc_id"], r["ratios"])
    assert len(got) == len(probes) + 1 and got[0] == pytest.approx(got[len(probes)])
    for i, probe in enumerate(probes):
        each, w = [ratio(p) for p in parts_of(probe)], words_of(probe)
        pairs = [pair(p) for p in zip(w, w[1:], strict=False)]
        best = (sorted((x for x in each if x > 0), reverse=True) + [0.0] * 4)[:4]
        want = [sum(best[:k]) / k for k in toxicity.STRONGEST] + [sum(each) / max(1, len(each)), sum(pairs) / max(1, len(each)), math.log1p(sum(max(x - toxicity.MARKED, 0) for x in each)), math.log1p(len(each))]
        assert got[i] == pytest.approx(want, abs=1e-4), probe


def test_scores_are_a_logistic_function_of_ratios(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice", "calm"], 30)) + (" vile vilest" if i % 2 else ""), "clash") for i in range(60)]
    df = spark.createDataFrame([*rows, rows[1], (None, "x", None)], "doc_id long, text string, RATIOS string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    found = toxicity.Detector(df, labels)
    for r in found.scored(df).collect():
        z = sum((x - c) / s * w for x, c, s, w in zip(r["ratios"], found.centre, found.scale, found.weights[:-1], strict=True)) + found.weights[-1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))
    assert found.scored(df.limit(0)).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    text = ("alpha beta gamma delta " * 300).strip()
    whole = sorted(h for g in toxicity.words([text, "x", None]) for h in g.hash[g.kind].tolist())
    monkeypatch.setattr(toxicity, "LONG", 100)
    monkeypatch.setattr(toxicity, "PIECE", 300)
    parts = [g for g in toxicity.words([text, "x", None])]
    assert len(parts) > 5 and sorted(h for g in parts for h in g.hash[g.kind].tolist()) == whole
    assert sum((g.owner == 0).sum() for g in parts) == 1200 and sum((g.owner == 1).sum() for g in parts) == 1
