"""The network learns from every window of every labelled document, wherever it lies."""

import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrill.llm import language

STEMS = {"aa": (["tion", "ing", "the"], ["kolo", "mura", "nebo"]), "bb": (["cht", "ung", "ein"], ["zepi", "tavu", "dyx"])}


def text(rng, stems, n=150):
    return " ".join("".join(rng.choice(stems, 2)) for _ in range(n))


def test_documents_beyond_the_first_by_hash_are_learned(spark):
    """The first four of a language by hash are written in words that no other document has."""
    ids = spark.range(600).select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).orderBy("h").collect()
    rng, rows, met = np.random.default_rng(4), [], {"aa": 0, "bb": 0}
    for r in ids:
        g = "bb" if r["id"] % 2 else "aa"
        rows.append((r["id"], text(rng, STEMS[g][met[g] >= 4]), g))
        met[g] += 1
    rows += [(1000 + i, text(rng, STEMS[g][1], 40), None) for i, g in enumerate(["aa", "bb"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.Identifier(df, docs_per_language=4, steps=60).labelled(df).where("doc_id >= 1000").collect()
    right = [r["lang_pred"] == ("bb" if r["doc_id"] % 2 else "aa") for r in got]
    assert len(right) == 40 and sum(right) >= 38


def small(spark):
    rng = np.random.default_rng(5)
    rows = [(i, text(rng, STEMS[g][i % 3 > 0], int(rng.integers(1, 60))), g) for i, g in enumerate(["aa", "bb"] * 60)]
    rows += [(7, "the same id", "aa"), (7, "the same id", "aa"), (8, "12 !?", "aa"), (9, "", "bb"), (10, None, "bb"), (None, "no id", "aa"), (11, "Ünd so weiter " * 900, "bb"), (12, "no label", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_blocks_hold_every_window_of_every_labelled_text(spark):
    rows, df = small(spark)
    known = language._known(df, "text", "lang", "doc_id", 256)
    got = sorted(w.tobytes() for r in language._blocks(known, ["aa", "bb"]).collect() for w in np.frombuffer(r["w"], np.uint8).reshape(-1, language.SPAN))
    texts = [t for i, t, g in rows if i is not None and t and g and language.has_letter(t.encode())]
    assert len(texts) == 123 and got == sorted(w.tobytes() for t in texts for w in language.cut(t.encode()))


def test_rounds_against_a_plain_loop(spark):
    _, df = small(spark)
    known, names = language._known(df, "text", "lang", "doc_id", 256), ["aa", "bb"]
    start = language.Network(2, 3, seed=2)
    got = language.fitted(start, names, known, 0.01)
    sizes = {r[0]: r[1] for r in known.groupBy("_lang").agg(F.sum(F.octet_length("text"))).collect()}
    total = sum(sizes.values())
    weigh = np.array([total / (2 * sizes[n]) for n in names], np.float32)
    net, expected = copy.deepcopy(start), total / (language.ROUNDS * language.READ * language.STEP)
    for turn in range(language.ROUNDS):
        rows = language._blocks(known.where(F.pmod(F.xxhash64(F.lit("round"), "_h", "_t"), F.lit(language.ROUNDS)) == turn), names).orderBy("key").collect()
        spans = np.concatenate([np.frombuffer(r["w"], np.uint8).reshape(-1, language.READ) for r in rows])
        y = np.concatenate([np.full(len(r["w"]) // language.READ, r["lang"]) for r in rows])
        adam = language.Adam(net)
        for i, at in enumerate(range(0, len(y), language.STEP)):
            x, who = spans[at : at + language.STEP].T, y[at : at + language.STEP]
            mask = (language.LETTER[x] + np.float32(1e-3)) * weigh[who]
            adam.step(x, who, mask, 0.01 * max(0.05, 1 - (turn + min(1, i / expected)) / language.ROUNDS) * len(who) / language.STEP)
    assert any(np.abs(got.weights[n] - start.weights[n]).max() > 0.002 for n in net.weights)
    for n in net.weights:
        assert got.weights[n] == pytest.approx(net.weights[n], abs=1e-4)


def test_the_network_does_not_depend_on_the_layout_of_files(spark, monkeypatch):
    _, df = small(spark)
    monkeypatch.setattr(language, "PART", 1 << 12)
    first, second = (language.Identifier(x, steps=20) for x in (df.repartition(2), df.repartition(7).sortWithinPartitions("lang")))
    assert first.names == second.names
    for n, w in first.net.weights.items():
        assert np.array_equal(w, second.net.weights[n]), n
