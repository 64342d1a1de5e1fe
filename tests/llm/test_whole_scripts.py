"""Quality and toxicity judge texts by what they say in any script, not by the script's rank."""

import numpy as np

from test_llm_small import docs
from test_whole_alphabet import HOT

from tallyrill.llm import quality, toxicity


def words(rng, base, n=12):
    return ["".join(chr(base + int(i)) for i in rng.integers(0, 40, 3)) for _ in range(n)]


def test_quality_of_rare_characters(spark):
    rng = np.random.default_rng(9)
    good, junk = words(rng, 0x4E00), words(rng, 0x5E00)
    texts = [" ".join(rng.choice(junk if i % 4 == 0 else good, 60)) for i in range(160)]
    hot = [HOT[:20_000]] * 40
    df = docs(spark, texts + hot)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(160)] + [(160 + i, 1) for i in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.Judge(df, labels, least=10).scored(df).collect()}
    assert [got[i] for i in range(160)] == [i % 4 != 0 for i in range(160)]


def test_toxic_words_of_rare_characters(spark):
    rng = np.random.default_rng(10)
    usual, bad = words(rng, 0x4E00, 25), words(rng, 0x4E00, 4)
    texts, marks = [], []
    for i in range(300):
        w = list(rng.choice(usual, 100))
        if i % 3 == 0:
            for at in rng.integers(0, 100, 3):
                w[int(at)] = str(rng.choice(bad))
        texts.append(" ".join(w))
        marks.append(int(i % 3 == 0))
    df = docs(spark, texts + [HOT] * 40)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i < 200] + [(300 + i, 0) for i in range(40)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.Detector(df, labels).scored(df, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(marks[i]) for i in range(200, 300)]) > 0.95


def _judged(spark, texts, marks, learn):
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i < learn], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.Detector(df, labels).scored(df, ["doc_id"]).collect()}
    return [got[i] >= 0.7 for i in range(learn, len(texts))]


def test_scripts_without_spaces_are_read_whole(spark):
    rng = np.random.default_rng(11)
    usual = [chr(0x4E00 + i) for i in range(300)]
    opening = "今天天气很好我们出去走走"
    texts, marks = [], []
    for i in range(400):
        body = list(rng.choice(usual, 200))
        if i % 4 == 0:
            for at in rng.integers(20, 190, 3):
                body[int(at)] = "你滚开去死"  # of characters that occur elsewhere as well
        else:
            for at in rng.integers(20, 190, 6):
                body[int(at)] = str(rng.choice(["滚动开始", "死海去年", "你好开会"]))
        texts.append(opening + "".join(body) + "。")
        marks.append(int(i % 4 == 0))
    assert np.mean(np.array(_judged(spark, texts, marks, 280)) == np.array(marks[280:], bool)) > 0.95


def test_a_very_long_word_is_read_to_its_end(spark):
    rng = np.random.default_rng(12)
    stems = ["tion", "ing", "ver", "ent", "ous", "able", "ment", "ist"]
    texts, marks = [], []
    for i in range(300):
        word = "international" + "".join(rng.choice(stems, 12)) + ("vileinsult" if i % 3 == 0 else "") + "".join(rng.choice(stems, 2))
        texts.append(" ".join(["plain words"] * 10 + [word]))
        marks.append(int(i % 3 == 0))
    assert np.mean(np.array(_judged(spark, texts, marks, 200)) == np.array(marks[200:], bool)) > 0.95


def test_expressions_of_harmless_words(spark):
    rng = np.random.default_rng(13)
    usual = ["sun", "moon", "tree", "bird", "lake", "hill", "road", "ship"]
    texts, marks = [], []
    for i in range(400):
        w = [str(x) for x in rng.choice(usual, 30)]
        w = [x for x, y in zip(w, ["", *w], strict=False) if (y, x) != ("drop", "dead")]
        for at in (3, 12, 21):
            w[at : at + 4] = ["drop", "dead", "some", "leaf"] if i % 4 == 0 else ["drop", "some", "dead", "leaf"]
        texts.append(" ".join(w))
        marks.append(int(i % 4 == 0))
    assert np.mean(np.array(_judged(spark, texts, marks, 280)) == np.array(marks[280:], bool)) > 0.95
