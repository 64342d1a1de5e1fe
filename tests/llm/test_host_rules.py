"""Host rules against a plain loop, on the cases that the docstring names."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyrill.llm import host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\x0b\x0c\r\n ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, " lead and trail \n", "é ü 漢字 \U0001f600 # $ <b>\n\n|\n|\r\n|\n", "a\x85b a b c"]
    for n in (9, 30, 200, 3000):
        out += [" ".join(rng.choice("abc") for _ in range(n)), "\n".join(rng.choice(("the cat", "sat on", "  ", "#1")) for _ in range(n))]
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_equal_a_plain_loop(spark):
    rows = [(i, t, "h", i) for i, t in enumerate(texts())]
    got = host_rules.counted(spark.createDataFrame(rows, "doc_id long, text string, source string, TEXT int")).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in got} == {i: plain(t) for i, t, *_ in rows}
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)


def test_hosts_are_judged_by_shrunk_rates(spark):
    good = " ".join(f"w{i}" for i in range(40))
    symbols = " ".join(f"#{i}" for i in range(40))  # passes by itself, counts against its host
    rows = [(i, good, f"good{i % 10}") for i in range(400)] + [(1000 + i, symbols, "bad") for i in range(60)] + [(2000 + i, good, "bad") for i in range(5)]
    rows += [(3000, symbols, "single"), (3001, symbols, None), (3002, good, None), (3003, "few words", "good0"), (3003, "few words", "good0")]
    got = {(r["doc_id"], r["host"]): r for r in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r["kept"] for (_, h), r in got.items() if h == "bad")
    assert all(r["kept"] == (not r["base_failed"]) for (_, h), r in got.items() if h != "bad" and h != "single")
    assert got[3003, "good0"]["kept"] is False and got[3001, None]["kept"] is True


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert host_rules.judged(df).count() == 0
    plan = host_rules.counted(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_a_host_without_documents_of_its_kind_is_the_prior(spark):
    rows = host_rules.counted(spark.createDataFrame([(i, "few", f"h{i}") for i in range(5)], "doc_id long, text string, source string"))
    rates = host_rules.host_rates(rows).agg(F.min("rate_few_words"), F.max("rate_few_words")).first()
    assert rates[0] == rates[1] == 1.0
