"""The difference recomputed from Python counts of the other documents, in one shard and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrill.llm import cross_entropy, shared

DOC = "doc_id long, text string, DIFFERENCE string, n_tokens int"


def split(text):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return cross_entropy.LONE.sub(lambda m: f" {m[0]} ", plain).replace("\t", " ").replace("\n", " ").split(" ") if plain else []


def brute(rows, targets, mu):
    """(tokens, target loss, background loss) of each row, by the other rows."""
    texts = [[w for w in split(t) if w] for _, t in rows]
    flags = [i in targets for i, _ in rows]
    types = len({w for t in texts for w in t})
    out = []
    for a, text in enumerate(texts):
        if not text:
            out.append((0, None, None))
            continue
        found = []
        for among in ([b for b in range(len(rows)) if flags[b] and b != a], [b for b in range(len(rows)) if b != a]):
            one, two, before = {}, {}, {}
            for b in among:
                for v, w in zip([None, *texts[b]], texts[b], strict=False):
                    one[w] = one.get(w, 0) + 1
                    two[v, w] = two.get((v, w), 0) + 1
                for v in [None, *texts[b]] if texts[b] else []:
                    before[v] = before.get(v, 0) + 1
            n = sum(one.values())
            found.append(-sum(math.log((two.get((v, w), 0) + mu * (one.get(w, 0) + 1) / (n + types + 1)) / (before.get(v, 0) + mu)) for v, w in zip([None, *text], text, strict=False)))
        out.append((len(text), found[0] / len(text), found[1] / len(text)))
    return out


@pytest.mark.parametrize(("shard_bytes", "batch"), [(1 << 24, 8 << 20), (40, 60)])
def test_scores_against_counting(spark, monkeypatch, shard_bytes, batch):
    monkeypatch.setattr(shared, "BATCH", batch)
    rng = np.random.default_rng(3)
    vocab = ["The", "cat", "sat", "été", "on", "a", "mat", "日本", "中国人"]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 25))))) for i in range(40)]
    rows += [rows[3], rows[3], (3, "other text"), (90, None), (91, ""), (92, " \n\t"), (None, "the cat"), (93, "unheard-of"), (94, "中国")]
    targets = {*range(0, 20), 93}
    labels = spark.createDataFrame([*((i, 1) for i in targets), (0, 0), (None, 1), (30, 0), (31, None)], "doc_id long, quality int")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC).repartition(3)
    got = sorted(([r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"], r["difference"]] for r in cross_entropy.score(df, labels, mu=2.0, shard_bytes=shard_bytes).collect()), key=repr)
    want = sorted(([i, n, t, b, None if t is None else t - b] for (i, _), (n, t, b) in zip(rows, brute(rows, targets, 2.0), strict=True)), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:] == ([None] * 3 if w[2] is None else pytest.approx(w[2:]))


def test_a_document_that_occurs_twice_stands_out(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 200, 20)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 100, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r["difference"] for r in cross_entropy.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    twice = [got[i] for i in range(0, 200, 20)]
    assert min(twice) > max(got[i] for i in range(200) if i % 20)


def test_no_documents_and_no_targets(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in cross_entropy.score(df, none).collect()}
    assert got[1]["target_loss"] == pytest.approx(math.log(3)) and got[2]["target_loss"] is None
    assert cross_entropy.score(df.limit(0), none).count() == 0


def test_blocks_grow_as_the_text_does(spark, monkeypatch):
    """A row for each slice and shard: with both growing by the square root, four times the text makes four times the rows."""
    monkeypatch.setattr(cross_entropy, "SLICE", 1 << 14)
    monkeypatch.setattr(cross_entropy, "SHARD", 1 << 15)
    monkeypatch.setattr(cross_entropy, "SMALL", 1 << 19)
    text = " ".join(f"w{i * 7919 % 4001}" for i in range(120))
    sent = []
    for times in (1, 4, 16):
        rows = spark.range(1000 * times).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(False).alias("flag"), F.concat(F.lit(text), F.lit(" "), F.col("id")).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
        slices = cross_entropy._slices(rows, size)
        asked = cross_entropy._requests(slices, -(-size // int(cross_entropy.SHARD * cross_entropy.growth(size))))
        sent.append(asked.where(F.col("kind") > 0).count())
    assert sent[1] < 6 * sent[0] and sent[2] < 6 * sent[1], sent
    assert cross_entropy.growth(1 << 60) == cross_entropy.GROWN and cross_entropy.growth(0) == 1


def test_many_targets_and_rows_without_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 5 else None, f"some words {i % 7} and more") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 3)] + [(None, 1)], "doc_id long, quality int")
    few = sorted(map(tuple, cross_entropy.score(docs, labels).collect()), key=repr)
    monkeypatch.setattr(cross_entropy, "TARGETS", 3)
    assert sorted(map(tuple, cross_entropy.score(docs, labels).collect()), key=repr) == few and len(few) == 60


def test_slices_without_a_word(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \t")], "doc_id long, text string").coalesce(1)
    got = cross_entropy.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["difference"]) for r in got) == [(1, 0, None), (2, 0, None), (3, 0, None)]
