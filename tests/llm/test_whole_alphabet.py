"""No character of the corpus is lost to the n-gram models, however many there are."""

import numpy as np

from test_llm_small import docs

from tallyrill.llm import cross_entropy, ngram

#: More characters than 7 bits hold, each more frequent than any other character.
HOT = "".join(chr(0x1100 + i) for i in range(200)) * 400


def test_spelled_characters_stay_apart():
    for points in ([32], [32, *range(0x100, 0x1100)]):
        letters = ngram.Alphabet(points)
        probe = [chr(p) for p in (*range(0x4E00, 0x5E00), 0x1F600, 0x3FFFF, 0x40000, 0xE0041, 0x10FFFF)]
        assert len({tuple(letters.symbols(c).tolist()) for c in probe}) == len(probe)
        assert all(letters.symbols(c).max() < 1 << letters.bits for c in probe)
        text = "".join(probe[:50]) + "a b" + "".join(probe[-5:])
        assert letters.symbols(text).tolist() == [s for c in text for s in letters.symbols(c).tolist()]
        assert sum(len(k) for k, _, _ in letters.keys([text, None, ""])) == len(letters.symbols(text))


def test_pieces_with_spelled_characters(monkeypatch):
    letters, text = ngram.Alphabet([32, 97]), "a中 国\U000e0041a" * 30
    whole = np.concatenate([k for k, _, _ in letters.keys([text])])
    monkeypatch.setattr(ngram, "PIECE", 7)
    assert np.array_equal(np.concatenate([k for k, _, _ in letters.keys([text])]), whole)


def test_many_scripts_in_shards(spark):
    df = docs(spark, [HOT, "中国人民 大学生活", "Ωμέγα"])
    letters = ngram.alphabet(df)
    rows = ngram.model(ngram.count_ngrams(df, letters), bits=letters.bits)
    one, many = ([r["log_likelihood"][0] for r in ngram.log_likelihoods(df, [rows], letters, max_shard_rows=bound).orderBy("doc_id").collect()] for bound in (10**6, 60))
    assert np.allclose(one, many)
    scorer = ngram.Scorer(ngram.collected(rows, bits=letters.bits), bits=letters.bits)
    context = next(letters.keys(["中国人民"]))[0][-1] << letters.bits & ((1 << 5 * letters.bits) - 1)
    assert abs(np.exp(scorer.log_p(np.arange(1 << letters.bits) + context)).sum() - 1) < 1e-4


def test_cross_entropy_tells_texts_of_rare_characters_apart(spark):
    rng = np.random.default_rng(8)
    words = [["".join(chr(0x4E00 + 40 * s + int(i)) for i in rng.integers(0, 40, 2)) for _ in range(12)] for s in (0, 1)]
    texts = [" ".join(rng.choice(words[i % 2], 30)) for i in range(40)]
    df = docs(spark, [*texts, HOT])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(20)], "doc_id long, quality int")
    got = {r["doc_id"]: r["difference"] for r in cross_entropy.score(df, labels).collect()}
    assert max(got[i] for i in range(0, 40, 2)) < min(got[i] for i in range(1, 40, 2))
