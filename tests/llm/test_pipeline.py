"""The pipeline's stages against brute force, each on what its predecessor kept, and on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_small import brute_components, brute_contamination, brute_kneser_ney

import corpus_pipeline
from tallyrill.llm import cross_entropy, language, ngram, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, items int"
STEMS = {"aa": ["tion", "ing", "the", "wor", "ly"], "bb": ["süß", "cht", "ung", "ein", "keit"]}


def corpus():
    rng = np.random.default_rng(11)
    rows, labels = [], []
    word = lambda g: "".join(rng.choice(STEMS[g], 2))
    for i in range(240):
        g = "aa" if i % 3 else "bb"
        words = [word(g) + (str(int(rng.integers(100))) if rng.random() < 0.1 else "") for _ in range(int(rng.integers(30, 60)))]
        if i % 10 == 9:
            words = ["".join(rng.choice(list("#@%&*{}~^"), 6)) for _ in words]
            labels.append((i, 0, 0))
        else:
            labels.append((i, 1, 0))
        rows.append([i, " ".join(words), g, f"s{i % 4}"])
    for i in range(240, 270):  # near copies: the last word changed
        rows.append([i, rows[i - 240][1].rsplit(" ", 1)[0] + " " + word("aa"), rows[i - 240][2], "s1"])
    items = [" ".join(word("aa") for _ in range(20)) for _ in range(3)]
    for i in range(270, 276):
        rows.append([i, " ".join(word("aa") for _ in range(20)) + " " + items[i % 3] + " " + word("bb"), "aa", None])
    rows += [[276, None, "aa", "s0"], [277, "", "aa", "s0"], [278, "12 34 .. 56", "aa", "s0"], [279, "  \t", None, "s0"], rows[2][:], rows[2][:]]
    rows = [(*r, len(r[1] or ""), "x", 7) for r in rows]
    return rows, [*labels, (None, 1, 1), (3, None, None)], [(i, t) for i, t in enumerate(items)] + [(9, None), (None, "x")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, DOC).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    kept.append(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "stage")
        kept.append(docs)
    return folder, kept


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_every_stage_keeps_the_columns_and_only_rows_it_was_given(made):
    _, kept = made
    for before, after in zip(kept, kept[1:], strict=False):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0 and after.count() > 0


def test_quality_stage_rejects_junk_and_empty_texts(spark, made):
    folder, kept = made
    judge = quality.Judge(kept[0], spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r["doc_id"]: r["keep"] for r in judge.scored().collect()}
    rows = kept[0].collect()
    assert ids(kept[1]) == sorted(r["doc_id"] for r in rows if scored[r["doc_id"]])
    assert not any(scored[i] for i in (276, 277)) and not any(scored[i] for i in range(240) if i % 10 == 9)
    assert np.mean([scored[i] for i in range(240) if i % 10 != 9]) > 0.97


def test_language_stage_rejects_what_is_told_less_surely_than_labelled_documents(made):
    _, kept = made
    left = set(ids(kept[2]))
    assert not left & {278, 279} and len(left) >= 0.97 * len(set(ids(kept[1])) - {278, 279})


def test_near_duplicate_stage_against_brute_force(made):
    _, kept = made
    rows = sorted(kept[2].collect(), key=lambda r: r["doc_id"])
    found = brute_components([r["text"] for r in rows], 5, 80)
    assert ids(kept[3]) == sorted({rows[root]["doc_id"] for _, _, root in found})
    assert len(ids(kept[3])) < len(rows) - 20


def test_benchmark_stage_against_brute_force(spark, made):
    folder, kept = made
    rows = kept[3].collect()
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id is not null").collect()]
    found = brute_contamination([r["text"] for r in rows], items)
    clean = [r["doc_id"] for r, (n, hit, _) in zip(rows, found, strict=True) if not (hit and 20 * len(hit) >= n)]
    assert ids(kept[4]) == sorted(clean) and len(clean) < len(rows)


def test_mix_of_what_is_left(spark, made):
    folder, kept = made
    size, weight = {}, {}
    for r in kept[4].collect():
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].split())
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, total = set(names), 1.5 * sum(size.values())
    while over := {s for s in left if weight[s] * total / sum(weight[x] for x in left) > 2 * size[s]}:
        total -= sum(2 * size[s] for s in over)
        left -= over
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == ids(kept[4])
    for s in names:
        rows = [r for r in got if r["source"] == s]
        want = weight[s] * total / sum(weight[x] for x in left) if s in left else 2 * size[s]
        assert rows[0]["target"] == pytest.approx(want) and rows[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in rows) - want) <= max(r["size"] for r in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = spark.createDataFrame([(1, "a b", None, None, 1, "x", 1), (1, "a b", None, None, 1, "x", 1), (None, None, None, None, None, None, None)], DOC)
    sizes = [stage(spark, rows, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES]
    assert sizes == [2, 2, 2, 3, 3]


# --- what the operators' columns say ----------------------------------------------------------


def small(spark):
    texts = ["abra cadabra abra", "bad abba", "cab a drab crab", "dab dab dab", "abba abra", "zzz zxz", None, "", "abba abra"]
    df = spark.createDataFrame([(i, t, ["x", "y", None][i % 3], "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, Perplexity string")
    return texts, df, spark.createDataFrame([(i, int(i != 5)) for i in range(9)], "doc_id long, quality int")


def loss(p, letters, text):
    return -sum(np.log(p(tuple(k >> (7 * i) & 127 for i in range(4, -1, -1)))) for key, _, _ in letters.keys([text]) for k in key.tolist())


def test_quality_columns_against_the_textbook(spark):
    texts, df, labels = small(spark)
    judge = quality.Judge(df, labels, least=2, evidence=3, quantile=0.5)
    fold = {r["doc_id"]: r["f"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).alias("f")).collect()}
    letters = ngram.alphabet(df.where(F.col("doc_id").isin([i for i in range(9) if i != 5 and fold[i] == 0])))
    p = brute_kneser_ney([t for i, t in enumerate(texts) if i != 5 and fold[i] == 0], letters, 5, 128)
    losses = {i: loss(p, letters, t) for i, t in enumerate(texts)}
    believed = [i for i in range(9) if i != 5 and fold[i] == 1 and texts[i]]
    mean = sum(losses[i] for i in believed) / sum(len(texts[i]) for i in believed)
    weighed = {i: (losses[i] + 3 * mean) / (len(t or "") + 3) for i, t in enumerate(texts)}
    low = lambda some: sorted(weighed[i] for i in some)[int(np.ceil(len(some) * 0.5)) - 1]
    for r in judge.scored().collect():
        i, own = r["doc_id"], [j for j in believed if ["x", "y", None][j % 3] == r["lang"]]
        limit = low(own) if len(own) >= 2 else low(believed)
        assert r["threshold"] == pytest.approx(np.exp(limit), rel=1e-3)
        assert r["keep"] == bool(texts[i] and weighed[i] <= limit * (1 + 1e-9)) or abs(weighed[i] - limit) < 1e-4
        if texts[i]:
            assert r["perplexity"] == pytest.approx(np.exp(losses[i] / len(texts[i])), rel=1e-3) and r["weighed"] == pytest.approx(np.exp(weighed[i]), rel=1e-3)
        else:
            assert r["perplexity"] is None and not r["keep"]


def test_language_bound_is_a_quantile_of_scores_told_rightly(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join("".join(rng.choice(STEMS[g], 2)) for _ in range(20)), g, 0.5) for i, g in enumerate(["aa", "bb"] * 100)]
    rows += [(900, "日 zz qq", None, 0.5), (901, "11", "aa", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.kept(df, quantile=0.1, least=10)
    assert got.columns == df.columns and 0.8 * 200 < got.count() < 200 and got.where("doc_id = 901").count() == 0
