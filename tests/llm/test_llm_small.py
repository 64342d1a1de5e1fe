"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrill import scratch
from tallyrill.llm import components, cross_entropy, decontaminate, grid, html_text, language, mixing, near_duplicates, ngram, quality, shared, topk, toxicity, url_rules
from tallyrill.llm.shingles import shingle_sets

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOC)


# --- shared -------------------------------------------------------------------------------


def test_clashing_and_repeated_column_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 9)], "doc_id long, text string, Score string, n_words long")
    got = decontaminate.scan(df, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "Score", "n_words", "hit_words", "items", "spans"]
    assert got.first()["n_words"] == 2
    both = df.selectExpr("doc_id", "text", "text AS TEXT", "doc_id AS doc_id2")
    assert shared.pick(both, {"t": "text"}).first()["t"] == "a b"
    assert near_duplicates.linked(both).count() == 1
    with pytest.raises(ValueError, match="no column"):
        shared.pick(df, {"t": "nope"})


def test_written_goes_where_the_session_says(spark, tmp_path, monkeypatch):
    shared.shared_dir(spark)  # the session's own
    class Named:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: f"file://{tmp_path}/" if key == "spark.checkpoint.dir" else default)})
        sparkContext = spark.sparkContext

    assert shared.shared_dir(Named) == f"file://{tmp_path}"
    monkeypatch.setattr(scratch, "shared_dir", lambda s: f"file://{tmp_path}")
    assert shared.written(spark.range(3), "t").count() == 3
    assert any(tmp_path.rglob("*.parquet"))
    shared.clear(spark)
    assert not any(tmp_path.rglob("*.parquet"))


# --- decontamination ----------------------------------------------------------------------


def brute_contamination(texts, items, window=13):
    word = decontaminate.WORD
    ws = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        d, hit, ids = ws(t), set(), set()
        for key, text in items:
            w = ws(text)
            k = min(window, len(w))
            for s in range(max(1, len(w) - window + 1) if w else 0):
                for p in range(len(d) - k + 1):
                    if d[p : p + k] == w[s : s + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(key))
        out.append((len(d), sorted(hit), sorted(ids)))
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["über", "Élan", "THE", "a1", "x", "y", "日本"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, text(20)), (2, "the x"), (10, text(13)), (3, None), (4, "..!"), (5, "the X!")]
    texts = [text(60) + ", " + items[0][1].upper().replace(" ", "-- ") + " end", None, "", "?!", "THE-x the\nX", text(400), items[2][1], items[2][1], "x " * 5000]
    bench = spark.createDataFrame(items + [items[1]], "item_id long, text string")
    want = brute_contamination(texts, items)
    for bound in (1 << 25, 300):  # one automaton, then several
        got = decontaminate.scan(docs(spark, texts), bench, max_shard_bytes=bound).orderBy("doc_id").collect()
        assert [(r["n_words"], r["hit_words"], r["items"]) for r in got] == want
        for r in got:
            covered = [w for a, b in r["spans"] for w in decontaminate.words(r["text"][a:b].encode())]
            assert len(covered) == len(r["hit_words"])
    empty = decontaminate.scan(docs(spark, texts), bench.limit(0)).collect()
    assert all(r["hit_words"] == [] for r in empty)
    assert decontaminate.scan(docs(spark, texts).limit(0), bench).count() == 0


# --- URL rules ----------------------------------------------------------------------------


def test_url_rules_against_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.ORG", "/en/1", "block"), ("org.example", "", "block"), ("b.example.org", None, "allow"), ("b.example.org", None, "block"), ("", "/", "block"), (None, "/", "block")]
    hosts = ["example.org", "a.EXAMPLE.org", "xexample.org", "example-x.org", "org", "b.example.org", "z.org.example", "com", ""]
    paths = ["", "/", "/es/1", "/en/12?x", "/en/2#y", "?q", "/es"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://", "https://example.org/es/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    tidy = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("org.example", "", "block"), ("b.example.org", "", "block")]
    for bound in (1 << 20, 80):
        got = {r["page_id"]: r for r in url_rules.judge_urls(pages, table, max_shard_bytes=bound).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
            fits = [r for r in tidy if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
            best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u


# --- top k --------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [1.0, 1e18])
def test_top_k_against_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(grid, "ANCHORS", 100)
    monkeypatch.setattr(grid, "CANDIDATES", 2000)
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((300, 24)), 2) * scale
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(50, rows[50][1]), (50, rows[7][1]), (900, None), (950, [1.0, None]), (1000, [float("nan")] * 24), (None, rows[3][1]), (1050, []), (1100, [1.0, 2.0]), (1150, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for a, (q, v) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-clip(sum(s * t for s, t in zip(v, w, strict=True))), i) for b, (i, w) in enumerate(good) if b != a and len(w) == len(v))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- mixing -------------------------------------------------------------------------------


def test_water_filling_and_sampling(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["b", "a", None, "c", "hot", "tiny"][min(int(rng.geometric(0.3)) - 1, 5)]) for i in range(3000)] + [(9000, None, "nul"), (9001, "", "nul"), (1, "w w", "a"), (1, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, mixing.cyclic_weights((3, 1, 2)))
    again = mixing.mix(df.repartition(7), mixing.cyclic_weights((3, 1, 2)))
    assert sorted(map(tuple, got.drop("source").collect())) == sorted(map(tuple, again.drop("source").collect()))
    by = {r["source"]: r for r in got.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s"), F.sum("taken").alias("k"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.max("size").alias("m")).collect()}
    names = sorted(k for k in by if k is not None) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, free, capped = 1.5 * sum(r["s"] for r in by.values()), set(names), 0
    while True:
        level = (total - capped) / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] > 2 * by[n]["s"]}
        if not over:
            break
        free -= over
        capped += sum(2 * by[n]["s"] for n in over)
    for n in names:
        want = level * weight[n] if n in free else 2 * by[n]["s"]
        assert abs(by[n]["t"] - want) < 1e-6 and by[n]["over"] <= 0 and abs(by[n]["k"] - want) <= by[n]["m"]
    assert by["nul"]["t"] == 0 and mixing.mix(df.limit(0), mixing.cyclic_weights()).count() == 0


# --- near duplicates ----------------------------------------------------------------------


def brute_components(texts, width, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(fold)) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rng = np.random.default_rng(width)
    vocab = [f"w{i}" for i in range(3000)] + ["Ünï", "the"]
    passage = list(rng.choice(vocab, 70))
    texts: list = [None, "", " \t\n", "one two", "One\ttwo", "one", "a b c d", "a b c d", "é É", "\u00a0 x"]
    for _ in range(60):
        base = list(rng.choice(vocab, int(rng.integers(4, 400))))
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                at = int(rng.integers(len(copy)))
                copy[at : at + 1] = list(rng.choice(vocab, int(rng.integers(0, 3))))
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    chain = list(rng.choice(vocab, 120))  # each links to the next, the ends do not
    for i in range(40):
        chain[3 * i] = f"new{i}"
        texts.append(" ".join(chain))
    texts.append(" ".join(rng.choice(vocab, 400_000)))  # longer than a piece
    df = docs(spark, texts).repartition(6)
    got = near_duplicates.linked(df, width=width, percent=percent)
    want = brute_components(texts, width, percent)
    assert sorted(map(tuple, got.collect())) == want
    kept = near_duplicates.representatives(df.withColumn("h", F.lit(1)), width=width, percent=percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in want if i == c] and kept.columns == [*df.columns, "h"]


def test_near_duplicates_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(near_duplicates.linked(df).collect(), key=str)
    assert sorted(r["component_id"] for r in got if r["n_shingles"] == 2) == [3, 3, 3, 3]
    assert near_duplicates.representatives(df).count() == 2
    assert near_duplicates.linked(df.limit(0)).count() == 0


def test_no_linked_pair_lacks_a_shared_key():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 100, 255, 256, 700, 1023, 1024, 3000]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for percent in (80, 85):
            most = near_duplicates.difference(len(a), len(a), percent)
            for cut in {0, most // 2, most}:
                grown = np.concatenate([a[cut // 2 :], rng.integers(0, 1 << 63, cut - cut // 2).astype(np.uint64)])
                b = np.unique(grown)
                both = len(np.intersect1d(a, b))
                if both * 100 >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(near_duplicates.block_keys(a, percent), near_duplicates.block_keys(b, percent)).size, (n, percent, cut)


def test_shingles_do_not_depend_on_grouping():
    texts = [b"a b c d e", b"x", b"", None, b"A\tb  c d E", ("é " * 9).encode()]
    alone = [next(iter(shingle_sets([t])))[1].tolist() for t in texts]
    assert [s.tolist() for _, s in shingle_sets(texts)] == alone and alone[0] == alone[4] and len(alone[5]) == 1


def test_giant_words_and_long_texts(monkeypatch):
    from tallyrill.llm import shingles

    giant, plain = b"g" * (shingles.LONG + 5), b" ".join(b"w%d" % i for i in range(200_000))
    texts = [giant, b"a b " + giant + b" c", plain + b" a b " + giant + b" c", plain, plain.replace(b" ", b"\t\n"), giant + b"h"]
    got = [set(s.tolist()) for _, s in shingle_sets(texts, 2)]
    assert got[1] <= got[2] and got[3] <= got[2] and len(got[0]) == 1 and got[0] != got[5] and got[3] == got[4] and len(got[3]) == 199_999
    assert {len(s) for _, s in shingle_sets([plain[: shingles.LONG - 1], plain[: shingles.LONG]], 2)} == {len(plain[: shingles.LONG].split()) - 1}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1300)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- n-gram models ------------------------------------------------------------------------


def brute_kneser_ney(texts, letters, order, vocabulary):
    """The textbook recursion over Python counts."""
    grams = {}
    for t in texts:
        for key, _, _ in letters.keys([t], order=order):
            for k in key.tolist():
                g = tuple(k >> (7 * i) & 127 for i in range(order - 1, -1, -1))
                grams[g] = grams.get(g, 0) + 1
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        down = {}
        for g in levels[k + 1]:
            down[g[1:]] = down.get(g[1:], 0) + 1
        levels[k] = down
    cuts = {k: ngram._discounts(*(sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4))) for k in levels}

    def p(g):
        k = len(g)
        if not k:
            return 1 / vocabulary
        follow = {h: c for h, c in levels[k].items() if h[:-1] == g[:-1]}
        if not follow:
            return p(g[1:])
        total = sum(follow.values())
        gamma = sum(cuts[k][min(c, 3) - 1] for c in follow.values()) / total
        c = follow.get(g, 0)
        return (max(c - cuts[k][min(c, 3) - 1], 0) / total if c else 0) + gamma * p(g[1:])

    return p


def test_kneser_ney_against_the_textbook(spark):
    texts = ["abra cadabra abra", "bad abba", "cab a drab crab", "dab dab dab", None, ""]
    probes = ["abracadabra", "zebra", "", None, "dab", "a b"]
    letters = ngram.alphabet(docs(spark, texts))
    rows = ngram.model(ngram.count_ngrams(docs(spark, texts), letters))
    p = brute_kneser_ney(texts, letters, 5, 128)
    for bound in (10**6, 40):
        got = ngram.log_likelihoods(docs(spark, probes), [rows], letters, max_shard_rows=bound).orderBy("doc_id").collect()
        for probe, r in zip(probes, got, strict=True):
            want = 0.0
            for key, _, _ in letters.keys([probe]):
                want += sum(np.log(p(tuple(k >> (7 * i) & 127 for i in range(4, -1, -1)))) for k in key.tolist())
            assert r["n_tokens"] == len(probe or "") and abs(r["log_likelihood"][0] - want) < 1e-3
    # probabilities of a context sum to one
    one = ngram.Scorer(ngram.collected(rows))
    context = next(letters.keys(["abra"]))[0][-1] << 7 & ((1 << 35) - 1)
    assert abs(np.exp(one.log_p(np.arange(128) + context)).sum() - 1) < 1e-4


def test_pieces_of_long_texts_score_as_a_whole(spark, monkeypatch):
    text = "lorem ipsum dolor " * 50
    letters = ngram.alphabet(docs(spark, [text]))
    whole = np.concatenate([k for k, _, _ in letters.keys([text, "x"])])
    monkeypatch.setattr(ngram, "PIECE", 37)
    assert np.array_equal(np.concatenate([k for k, _, _ in letters.keys([text, "x"])]), whole)


def test_hash_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 35, 5000))
    table = ngram.Table(keys, np.arange(len(keys), dtype=np.float32))
    value, found = table.get(np.concatenate([keys, keys + (1 << 36)]))
    assert found.tolist() == [True] * len(keys) + [False] * len(keys) and np.array_equal(value[: len(keys)], np.arange(len(keys)))


WORDS = {"good": "the quick brown fox jumps over a lazy dog while rain falls on green hills".split(), "junk": "XQ!! ZZ## %%KK QW** !!!".split()}


def written_corpus(spark, n=160):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS["junk" if i % 4 == 0 else "good"], 60)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs(spark, texts + [None, "", "fox"]), labels, n


def test_quality_and_cross_entropy(spark):
    df, labels, n = written_corpus(spark)
    got = {r["doc_id"]: r for r in quality.Judge(df, labels, least=10).scored(df).collect()}
    assert all(got[i]["keep"] == (i % 4 != 0) for i in range(n))
    assert not got[n]["keep"] and got[n]["perplexity"] is None and got[n + 2]["keep"]
    kept = quality.Judge(df, labels, least=10).kept(df.withColumn("extra", F.lit(1)))
    assert kept.columns == [*df.columns, "extra"] and {r["doc_id"] for r in kept.collect()} == {i for i in range(n) if i % 4} | {n + 2}
    scores = {r["doc_id"]: r["difference"] for r in cross_entropy.score(df, labels).collect()}
    assert max(scores[i] for i in range(n) if i % 4) < min(scores[i] for i in range(0, n, 4)) and scores[n] is None
    none = labels.limit(0)
    assert quality.Judge(df, none).scored(df).where("keep").count() == n + 1
    assert cross_entropy.score(df, none).count() == n + 3 and quality.Judge(df.limit(0), labels).scored(df.limit(0)).count() == 0


def test_toxicity_finds_few_words_in_long_texts(spark):
    rng = np.random.default_rng(7)
    texts, marks = [], []
    for i in range(400):
        w = list(rng.choice([a + b for a in ("ra", "lo", "mi", "te", "su") for b in ("na", "pel", "dor", "vik", "st")], 200))
        if i % 3 == 0:
            for _ in range(3):
                w[int(rng.integers(200))] = "grukh" + str(rng.choice(["a", "el", "ing", "um"]))
        texts.append(" ".join(w))
        marks.append(int(i % 3 == 0))
    df = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i < 250] + [(None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.Detector(df, labels).scored(df, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(marks[i]) for i in range(250, 400)]) > 0.97
    assert got[400] == got[401] < 0.7 and len(got) == 402
    assert toxicity.Detector(df, labels.limit(0)).scored(df).where("score <> 0").count() == 0
    assert toxicity.Detector(df, labels.where("toxic = 1")).scored(df).where("score <> 1").count() == 0


# --- language -----------------------------------------------------------------------------


def test_gradients_by_differences():
    net = language.Network(3, 4, seed=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(8)
    x, y, mask = rng.integers(97, 110, (6, 5)), rng.integers(0, 3, 5), np.ones((6, 5))
    _, g = net.gradients(x, y, mask)
    for name, w in net.weights.items():
        at = tuple(int(rng.integers(s)) for s in w.shape) if name[0] != "w" else (2, int(x[2, 1]))
        w[at] += 1e-5
        up = net.gradients(x, y, mask)[0]
        w[at] -= 2e-5
        down = net.gradients(x, y, mask)[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name


def test_language_id(spark):
    rng = np.random.default_rng(9)
    stems = {"aa": ["tion", "ing", "the"], "bb": ["süß", "cht", "ung"], "cc": ["ción", "que", "ado"]}
    rows = [(i, " ".join("".join(rng.choice(stems[g], 2)) for _ in range(40)), g) for i, g in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (1003, "日本語", None), (1004, "the " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.Identifier(df, F.col("doc_id") < 120, steps=120).labelled(df).collect()}
    assert np.mean([got[i]["lang_pred"] == g for i, _, g in rows[120:180]]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] != "und" and got[1004]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.Identifier(df.limit(0)).labelled(df).where("lang_pred <> 'und'").count() == 0


# --- pages --------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Alpha</a></li></ul></nav>
<div class="cookie-notice">We use cookies, you know. Really, we do use them; always.</div>
<div id="wrap"><h1>Title&nbsp;of&#32;it</h1><p>First <b>bold</b> words, with a <a href="/x">link</a>; and more text here.<br>
Second &amp; third line &lt;b&gt; of it, which goes on and on.<p>Another paragraph, that was never closed. It has two sentences.
<ul><li>An item</li><li>Two items</ul><script>var x = "<p>never</p>";</script><!-- <p>nor this, ever. It is a comment.</p> -->
<form><p>Your mail, please, now: and here.</p><input></form></div>
<aside><p>Aside, with a long text; that is no article at all, really. None.</p></aside>
<section class="comments"><p>First! A reader's comment, and a long one, which is not the article, at all.</p></section>
<footer>&copy; all, rights, reserved.</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title of it\nFirst bold words, with a link; and more text here. Second & third line <b> of it, which goes on and on.\nAnother paragraph, that was never closed. It has two sentences.\nAn item\nTwo items"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<", "<"), ("<p", ""), ("plain text", "plain text"), ("<script>x", ""), ("<p>a < b", "a < b"), ('<article><p title="a>b">x, y.</p><p>z', "x, y.\nz"), ("<article><p>a &amp", "a &"), ("<article><header><h1>T</h1><div>by</div></header><p>x.</p></article><nav>n</nav>", "T\nby\nx.")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_pages_table_and_long_pages(spark):
    df = spark.createDataFrame([(1, "<article><p>" + "word, " * 50_000), (2, "<" * 20_000), (3, None), (3, None), (4, '<p a="' + "x" * 50_000), (5, "<div>" * 5000 + "x")], "page_id long, html string")
    got = html_text.extract(df, keep=["page_id"]).collect()
    assert len(got) == 6 and {r["page_id"]: r["n_chars"] for r in got}[1] == 6 * 50_000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)
