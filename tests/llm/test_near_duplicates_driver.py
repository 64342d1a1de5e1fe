"""The n-gram Jaccard join brings no table through the driver, and lists what is left at once where that is little."""

import numpy as np
from test_llm_small import brute_components

from tallyrill.llm import near_duplicates


def texts():
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(int(rng.integers(4000)))
    bases = [[word() for _ in range(60)] for _ in range(12)]
    out = [" ".join(b) for b in bases]
    for b in bases:
        for _ in range(4):
            near = list(b)
            for at in rng.integers(0, 60, 2):
                near[at] = word()
            out.append(" ".join(near))
    return [*out, *out[:5], "a b", None, ""]


def test_no_broadcast_and_one_listing(spark, monkeypatch):
    rows, plans, write = texts(), [], near_duplicates.written

    def noted(df, label, group=None):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label, group)

    monkeypatch.setattr(near_duplicates, "written", noted)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = near_duplicates.linked(df, width=5, percent=80)
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert [found[i] for i in range(len(rows))] == [root for _, _, root in brute_components(rows, 5, 80)]
    assert len(plans) > 8 and not [label for label, plan in [*plans, ("linked", got._jdf.queryExecution().executedPlan().toString())] if "Broadcast" in plan]
    assert sum(label == "left" for label, _ in plans) <= 1


def test_many_pairs_are_listed_nearest_first(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    both = []
    for most in (near_duplicates.LISTED, -1):
        monkeypatch.setattr(near_duplicates, "LISTED", most)
        both.append(sorted(near_duplicates.linked(df, width=5, percent=80).collect()))
    assert both[0] == both[1]
