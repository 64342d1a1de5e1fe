"""The network's answers against a plain loop, the bound of languages, and clashing columns of language ID and the mix."""

import math

import numpy as np
import pytest

from tallyrill.llm import language, mixing

CLASH = "doc_id long, text string, lang string, source string, TEXT string, LANG string, Lang_Pred string, TAKEN long"


def plain_logits(net, window):
    """Position by position and unit by unit, after the gated recurrent unit's equations."""
    k, out = net.units, [[float(x) for x in net.weights["b"][:, 0]] for _ in window]
    sigma = lambda x: 1 / (1 + math.exp(-x))
    for d in "01":
        w, u, o = (net.weights[n + d].astype(float) for n in "wuo")
        h = [0.0] * k
        for t in range(len(window)) if d == "0" else reversed(range(len(window))):
            a = [w[i][window[t]] for i in range(3 * k)]
            b = [sum(u[i][j] * h[j] for j in range(k)) for i in range(3 * k)]
            keep = [sigma(a[i] + b[i]) for i in range(k)]
            reset = [sigma(a[k + i] + b[k + i]) for i in range(k)]
            new = [math.tanh(a[2 * k + i] + reset[i] * b[2 * k + i]) for i in range(k)]
            h = [keep[i] * h[i] + (1 - keep[i]) * new[i] for i in range(k)]
            for c in range(len(o)):
                out[t][c] += sum(o[c][j] * h[j] for j in range(k))
    return np.array(out)


def plain_pooled(net, text, languages):
    if not text or not any(c.isalpha() for c in text):
        return np.zeros(languages)
    raw = text.encode()
    raw += b" " * (-len(raw) % language.SPAN)
    total, n = np.zeros(languages), 0
    for at in range(0, len(raw), language.SPAN):
        window = raw[at : at + language.SPAN]
        for byte, z in zip(window, plain_logits(net, window), strict=True):
            if byte >= 128 or chr(byte).isalpha():
                p = np.exp(z - z.max())
                total += p / p.sum()
                n += 1
    return total / n


@pytest.mark.parametrize("units, languages", [(3, 2), (8, 5)])
def test_inference_equals_a_plain_loop(monkeypatch, units, languages):
    net = language.Network(languages, units, seed=units)
    net.weights["b"] += np.arange(languages, dtype=np.float32)[:, None] / 3
    window = "Été, 漢字 and so on; the rest of it is here, 12!".encode()[:40]
    assert net.logits(np.frombuffer(window, np.uint8)[:, None])[:, :, 0] == pytest.approx(plain_logits(net, window), abs=1e-4)
    texts = ["the cat", None, "", "12 !?", "é" * 100, "mixed 漢字 text, " * 9, "x"]
    monkeypatch.setattr(language, "ROWS", 3)
    got = language.pooled(net, [t if t is None else t.encode() for t in texts], languages)
    assert got == pytest.approx(np.array([plain_pooled(net, t, languages) for t in texts]), abs=1e-4)


def rows(n=60):
    rng = np.random.default_rng(3)
    stems = {"aa": ["tion", "ing", "the"], "bb": ["süß", "cht", "ung"]}
    return [(i, " ".join("".join(rng.choice(stems[g], 2)) for _ in range(30)), g, "s", "other", "zz", "yy", 7) for i, g in enumerate(["aa", "bb"] * (n // 2))]


def test_clashing_columns_of_language_id(spark):
    df = spark.createDataFrame([*rows(), (900, "12", "aa", "s", "letters", None, None, 1), (901, None, None, None, None, None, None, None)], CLASH)
    got = language.Identifier(df, steps=60).labelled(df, ["doc_id"])
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.where("doc_id >= 900 and lang_pred = 'und'").count() == 2
    kept = language.kept(df)
    assert kept.columns == df.columns and kept.where("doc_id >= 900").count() == 0 and kept.count() > 50


def test_clashing_columns_without_labels(spark):
    df = spark.createDataFrame([(i, t, None, None, "12", None, None, None) for i, t in enumerate(["words", "12", None, "é"])], CLASH)
    assert sorted(r[0] for r in language.kept(df).collect()) == [0, 3] and language.kept(df).columns == df.columns


def test_the_rarest_languages_beyond_the_bound_are_not_learned(spark):
    stray = [(1000 + i, "stray words", f"l{i:03}", "s", "", "", "", 0) for i in range(30)]
    df = spark.createDataFrame(rows() + stray, CLASH)
    found = language.Identifier(df, steps=5, max_languages=4)
    assert found.names == ["aa", "bb", "l000", "l001"]
    assert found.labelled(df).where("lang_pred not in ('aa', 'bb', 'l000', 'l001')").count() == 0


def test_clashing_columns_of_the_mix(spark):
    df = spark.createDataFrame([*rows(), (901, None, None, None, None, None, None, None)], CLASH)
    got = mixing.mix(df, mixing.cyclic_weights((3, 1, 2)))
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert got.count() == 61 and got.where("size = 30").count() == 60 and got.where("doc_id = 901 and size = 0 and taken = 0").count() == 1
