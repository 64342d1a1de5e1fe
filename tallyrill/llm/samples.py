"""Bounded, documented samples of labelled documents, on which classifiers are fitted.

A sample is chosen by hash: of each group the rows with the smallest hashes of their ids, at most its
bound.  Every task keeps the first rows of each group that it meets, and the tasks' lists are merged
the same way, so no task and no driver ever holds more than a bound a group, whatever the number of
rows, of groups with a third of all rows, or of rows with the same id (those count as one: of their
texts the smallest by hash is taken).
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.shared import mapped, pick

#: Rows that a task holds of all groups together before it passes some on; a bound of memory, not of the sample.
HELD = 200_000
PARTS = 32


def first_by_hash(rows: DataFrame, group: str, bounds: Mapping | int, keys: tuple[str, ...] = ("_h",)) -> DataFrame:
    """Of each value of ``group`` the first rows by the long columns ``keys`` (ties in all of them count once),
    at most its bound; ``bounds``: one for all, or by value (others get none).

    ``rows`` has the columns ``group`` and ``keys`` only.  Three rounds of a bounded heap a group: over
    the rows as they lie, over what that left, dealt by group and one of ``PARTS`` parts, and over what is left then by
    group.  So the last task of a group never meets more than ``PARTS`` times its bound.
    """
    rows = rows.select(group, *keys).where(F.col(group).isNotNull())
    if isinstance(bounds, Mapping):
        rows = rows.where(F.col(group).isin(list(bounds)))
    limit = dict(bounds) if isinstance(bounds, Mapping) else bounds

    def run(batches):
        heaps: dict = {}
        seen: dict = {}
        held = 0

        def out():
            made = [(g, *(~x for x in key)) for g, heap in heaps.items() for key in heap]
            arrays = [pa.array([m[0] for m in made], kind)] + [pa.array([m[i + 1] for m in made], pa.int64()) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays(arrays, names=[group, *keys])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for g, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                most = limit.get(g, 0) if isinstance(limit, dict) else limit
                item, heap, known = tuple(~x for x in key), heaps.setdefault(g, []), seen.setdefault(g, set())
                if item in known or (len(heap) >= most and (not heap or item < heap[0])):
                    continue
                known.add(item)
                held += 1
                heapq.heappush(heap, item)
                if len(heap) > most:
                    known.discard(heapq.heappop(heap))
                    held -= 1
            if held > HELD:  # very many groups: what is held goes on to the next round as it is
                yield out()
                heaps, seen, held = {}, {}, 0
        if held:
            yield out()

    schema = T.StructType([T.StructField(group, rows.schema[group].dataType)] + [T.StructField(k, T.LongType()) for k in keys])
    near = mapped(rows, run, schema)
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS))
    return mapped(mapped(near.repartition(group, part), run, schema).repartition(group), run, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bounds: Mapping[int, int], id_col: str = "doc_id", text_col: str = "text", seed: str = "sample", docs_id_col: str | None = None) -> DataFrame:
    """``doc_id, text, label``: of each label value at most ``bounds[value]`` documents, the first by hash of their ids.

    The ids are chosen from the narrow table of labels; of the rows with a chosen id one is taken, by
    hash of the text, so rows are bounded as well as ids: at most ``sum(bounds.values())``.
    ``id_col`` names the id in both tables, unless ``docs_id_col`` names it in ``docs``.
    Null ids and labels are left out; an id with two labels counts for the larger.
    """
    place = F.xxhash64(F.lit(seed), F.col("_id").cast("string"))
    ids = pick(labels, {"_id": id_col, "_label": label}).where(F.col("_id").isNotNull() & F.col("_label").isin(list(bounds))).groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = first_by_hash(ids.withColumn("_h", place).select("_label", "_h"), "_label", bounds)
    texts = pick(docs, {"_id": docs_id_col or id_col, "text": text_col}).where("_id is not null").withColumn("_h", place)
    found = texts.join(F.broadcast(chosen), "_h")
    return found.groupBy("_h").agg(F.min("_id").alias("doc_id"), F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_label").alias("label")).select("doc_id", "text", "label")
