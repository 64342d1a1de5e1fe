"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.
Each window of ``window`` consecutive words of an item (the whole item, when it has
fewer but some) becomes a pattern ``" w1 ... wk "``.  A document is normalised once to
``" w1 w2 ... wn "`` and scanned once; the end of a match gives the index of its last
word, and word indices are mapped back to character offsets of the original text.

The automaton is built on the driver from windows whose total size is measured first.
Up to ``max_shard_bytes`` there is one automaton, broadcast to the tasks.  Beyond, the
windows are dealt by hash into shards within the bound, and the documents are scanned once a
shard; one automaton is alive at a time, and what it finds is written by hash of the text.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item
has no windows; items without an id are ignored; items that share an id count once; two
items with the same window are both counted; repeated rows are judged one by one; an empty
table gives no rows.  Extra columns are carried through (see ``shared.arrow_map``).
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.shared import arrow_map, in_passes, pick, utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: ASCII that is no letter or digit becomes a space, A-Z become a-z; bytes from 0x80 on stay.
FOLD = bytes((c | 0x20) if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Distinct ``(window, item)``: the patterns of the automaton with the item's id as a string."""
    lowered = F.translate(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = pick(benchmark, {"_item": item_col, "_text": text_col}).where("_item is not null and _text is not null").select(F.col("_item").cast("string").alias("item"), ws.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, window), " "))).alias("window")).distinct()


def _automaton(rows: list) -> ahocorasick.Automaton:
    """Patterns are UTF-8 read as Latin-1, so that an offset is an offset of bytes."""
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(" " + r["window"].encode().decode("latin-1") + " ", []).append(r["item"])
    out = ahocorasick.Automaton()
    for pattern, items in by.items():
        out.add_word(pattern, (pattern.count(" ") - 1, tuple(sorted(items))))
    out.make_automaton()
    return out


def spans_of(text: str, hit: list[int]) -> list[list[int]]:
    """Character offsets [start, end) in the original text of each run of hit words."""
    at = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out: list[list[int]] = []
    for i, k in enumerate(hit):
        if i and hit[i - 1] == k - 1:
            out[-1][1] = at[k][1]
        else:
            out.append(list(at[k]))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, keep: list[str] | None = None, spans: bool = True, max_shard_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``docs`` with ``n_words``, ``hit_words`` (indices of hit words, ascending),
    ``items`` (ids of items with occurring windows, sorted as strings) and ``spans``
    (character offsets of the hit runs; empty where ``spans`` is false)."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    total = windows.agg(F.sum(F.octet_length("window") + 8)).first()[0] or 0
    shards = max(1, -(-total // max_shard_bytes))

    def automaton(shard: int):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard).collect()
        return spark.sparkContext.broadcast(_automaton(rows)) if rows else None

    if shards == 1:
        only = automaton(0)
        return arrow_map(docs, lambda: _scanner(only, spans), {"text": text_col}, FOUND, keep)

    def one(shard: int):
        def run(texts: DataFrame) -> DataFrame:
            shared = automaton(shard)
            return arrow_map(texts, lambda: _scanner(shared, False), {"text": "text"}, FOUND, ["_text_hash"]).drop("spans")

        return run

    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    kept = [c for c in dict.fromkeys(docs.columns if keep is None else keep) if c.lower() not in FOUND.names]
    carried = [*kept, *([text_col] if spans and text_col not in kept else [])]
    found = in_passes(docs, text_col, carried, (one(s) for s in range(shards)), [F.first("n_words").alias("n_words"), union("hit_words"), union("items")])
    if not spans:
        return found.withColumn("spans", F.array().cast(FOUND["spans"].dataType))
    return arrow_map(found, lambda: _spanned, {"text": text_col, "hit_words": "hit_words"}, T.StructType([FOUND["spans"]]), [*kept, *FOUND.names[:3]])


def _spanned(batch: pa.RecordBatch):
    texts, hits = batch.column("text").to_pylist(), batch.column("hit_words").to_pylist()
    return {"spans": pa.array([spans_of(t, h) if h else [] for t, h in zip(texts, hits, strict=True)], pa.list_(pa.list_(pa.int32())))}, None


def _scanner(automaton, want_spans: bool):
    found = automaton.value if automaton is not None else None

    def step(batch: pa.RecordBatch):
        n, hits, items, spans = [], [], [], []
        for text in utf8(batch.column("text")):
            ws = words(text)
            n.append(len(ws))
            hit: set[int] = set()
            item: set[str] = set()
            if ws and found is not None:
                line = b" " + b" ".join(ws) + b" "
                if matches := [*found.iter(line.decode("latin-1"))]:
                    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
                    ends = np.searchsorted(gaps, [e for e, _ in matches])  # the gap after word k - 1 has number k
                    for e, (_, (length, ids)) in zip(ends.tolist(), matches, strict=True):
                        hit.update(range(e - length, e))
                        item.update(ids)
            places = sorted(hit)
            hits.append(places)
            items.append(sorted(item))
            spans.append(spans_of(text.decode(), places) if places and want_spans else [])
        return {"n_words": pa.array(n, pa.int64()), "hit_words": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32())))}, None

    return step


def judged(scanned: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: some word is hit, and at least one in ``share``."""
    n_hit = F.size("hit_words").cast("long")
    return scanned.withColumns({"n_hit": n_hit, "contaminated": (n_hit > 0) & (share * n_hit >= F.col("n_words"))})
