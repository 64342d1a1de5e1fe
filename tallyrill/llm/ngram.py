"""Interpolated modified Kneser-Ney models over characters, built by sharded count joins.

A text becomes symbols: 0 is the boundary before it, and every character of the texts that set
the alphabet has its own; white space is one symbol.  The alphabet sets the width of a symbol, from
``BITS`` to ``MOST_BITS`` bits (less where the order is above 5).  Characters that the alphabet
lacks (not among the texts that set it, or beyond the 4,030 most frequent that ``MOST_BITS`` holds)
are spelled: the escape 1, then three digits of 6 bits, high to low (code points from 2 ** 18 on: two
escapes, four digits).  So no two characters are one, and the escape's probability is divided
among the characters it stands for by those of the digits.
An n-gram is a long of the alphabet's ``bits`` a symbol, the last symbol lowest.

Building is distributed: tasks count their own n-grams, the counts are summed by key, lower
orders count distinct left neighbours, context totals are grouped by prefix, and each
order's probabilities are joined with those of the next lower one by suffix.  What leaves
the cluster are three sums a model for the discounts.  The finished tables are measured;
they go to the scoring tasks in shards of at most ``max_shard_rows`` n-grams, dealt by the
two symbols before the last, so that a position finds all it needs in a single shard
(orders below 3, at most the square of the number of symbols met, are in each).  Beyond one shard the texts are
read once a shard, with one shard alive at a time; its sums are written by hash of the text and added in the end.

A null or empty text has no symbols and a log-likelihood of 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.shared import arrow_map, in_passes, mapped, pick, written

#: Least and most bits of a symbol, and the order: ``MOST_BITS * ORDER`` fit a long.
BITS, MOST_BITS, ORDER = 7, 12, 5
#: Symbols besides characters: boundary, escape, and the digits (the highest symbols).
ESCAPE, DIGIT_BITS = 1, 6
DIGITS = 1 << DIGIT_BITS
#: Symbols handled at once, and distinct n-grams that a counting task holds before it emits them.
PIECE, HELD = 1 << 18, 1_000_000


# --- symbols ------------------------------------------------------------------------------


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def fold(text: str | None, lower: bool) -> str:
    return "" if text is None else text.lower() if lower else text


def room(bits: int) -> int:
    """Characters that symbols of so many bits hold."""
    return (1 << bits) - 2 - DIGITS


class Alphabet:
    """Code points to symbols."""

    def __init__(self, points: list[int], most_bits: int = MOST_BITS) -> None:
        self.bits = min(most_bits, max(BITS, (len(points) + 1 + DIGITS).bit_length()))
        self.table = np.zeros(0x110000, np.uint16)  # 0: to be spelled
        for i, p in enumerate(points[: room(self.bits)]):
            self.table[p] = i + 2
        for space in (9, 10, 11, 12, 13, 0x85, 0xA0):
            self.table[space] = self.table[32]

    def __getstate__(self):
        at = np.nonzero(self.table)[0]
        return at, self.table[at], self.bits

    def __setstate__(self, state) -> None:
        self.table = np.zeros(0x110000, np.uint16)
        self.table[state[0]] = state[1]
        self.bits = state[2]

    def symbols(self, text: str) -> np.ndarray:
        """One symbol for each known character, the spelling for each other."""
        points = code_points(text)
        ids = self.table[points]
        rare = ids == 0
        if not rare.any():
            return ids
        width = np.where(rare, np.where(points >> (3 * DIGIT_BITS), 6, 4), 1)
        start = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint16)
        out[start[~rare]] = ids[~rare]
        p, at, end, digit = points[rare], start[rare], (start + width)[rare], (1 << self.bits) - DIGITS
        out[at] = ESCAPE
        for k in range(3):
            out[end - 1 - k] = digit + (p >> (DIGIT_BITS * k) & (DIGITS - 1))
        far = end - at == 6
        out[at[far] + 1] = ESCAPE
        out[at[far] + 2] = digit + (p[far] >> (3 * DIGIT_BITS))
        return out

    def keys(self, texts: list[str | None], lower: bool = False, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per group of whole texts or pieces of a text: n-gram keys, document of each, symbols of each."""
        owners, parts, total = [], [], 0
        for i, raw in enumerate(texts):
            text = fold(raw, lower)
            for start in range(0, len(text), PIECE):
                ids = self.symbols(text[start : start + PIECE])
                before = self.symbols(text[max(0, start - order + 1) : start])
                before = before[max(0, len(before) - order + 1) :]
                pad = np.zeros(order - 1 - len(before), np.uint16)
                parts.append(np.concatenate([pad, before, ids]))
                owners.append((i, len(ids)))
                total += len(ids)
                if total >= PIECE:
                    yield self._keys(parts, owners, order, self.bits)
                    owners, parts, total = [], [], 0
        if parts:
            yield self._keys(parts, owners, order, self.bits)

    @staticmethod
    def _keys(parts: list[np.ndarray], owners: list[tuple[int, int]], order: int, bits: int):
        symbols = np.concatenate(parts)
        key = symbols[order - 1 :].astype(np.int64)
        for k in range(1, order):
            key |= symbols[order - 1 - k : len(symbols) - k].astype(np.int64) << (bits * k)
        ends = np.cumsum([n + order - 1 for _, n in owners])
        real = np.ones(len(key), bool)
        for k in range(1, order):  # positions whose window runs over into the next part
            at = ends[:-1] - k
            real[at[at < len(key)]] = False
        doc = np.repeat([i for i, _ in owners], [n for _, n in owners])
        return key[real], doc, symbols[order - 1 :][real]


def alphabet(texts: DataFrame, text_col: str = "text", lower: bool = False, order: int = ORDER) -> Alphabet:
    """The characters of all texts, the most frequent first, ties by code point; at most ``room(MOST_BITS)`` rows are collected."""

    def run(batches):
        held = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for start in range(0, len(text or ""), PIECE):
                    got = code_points(fold(text[start : start + PIECE], lower))
                    if len(got):
                        held[: int(got.max()) + 1] += np.bincount(got)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["point", "n"])

    counts = mapped(pick(texts, {"t": text_col}), run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    most = max(BITS, min(MOST_BITS, 63 // order))
    return Alphabet([32] + [r["point"] for r in counts.where("point not in (9, 10, 11, 12, 13, 32, 133, 160)").orderBy(F.desc("n"), "point").limit(room(most) - 1).collect()], most)


# --- counts -------------------------------------------------------------------------------


def count_ngrams(texts: DataFrame, letters: Alphabet, text_col: str = "text", lower: bool = False, order: int = ORDER) -> DataFrame:
    """``key, n`` over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(letters)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged(done: bool):
            nonlocal held
            if held:
                keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)
                held = [(keys, counts)]
                if done or len(keys) > HELD:
                    held = []
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        for batch in batches:
            for key, _, _ in shared.value.keys(batch.column(0).to_pylist(), lower, order):
                held.append(np.unique(key, return_counts=True))
                if sum(len(h[0]) for h in held) > HELD:
                    yield from merged(False)
        yield from merged(True)

    return mapped(pick(texts, {"t": text_col}), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# --- the model ----------------------------------------------------------------------------


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of Chen and Goodman; with too few counts of counts to tell, half a count."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * (n3 or 0) / n2, 3 - 4 * y * (n4 or 0) / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def _by_count(n: Column, values: tuple[float, float, float]) -> Column:
    return F.when(n >= 3, values[2]).when(n == 2, values[1]).when(n == 1, values[0]).otherwise(0.0)


def _level(counts: DataFrame, lower: DataFrame | None, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Probabilities ``key, p`` of order ``k`` and back-off weights ``context, gamma``."""
    seen = counts.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()
    d = _discounts(*seen)
    contexts = counts.groupBy(F.shiftright("key", bits).alias("context")).agg(F.sum("n").alias("total"), F.sum(_by_count(F.col("n"), d)).alias("cut")).select("context", "total", (F.col("cut") / F.col("total")).alias("gamma"))
    own = counts.withColumn("context", F.shiftright("key", bits)).join(contexts, "context")
    kept = F.greatest(F.col("n") - _by_count(F.col("n"), d), F.lit(0.0)) / F.col("total")
    if lower is None:
        return own.select("key", (kept + F.col("gamma") / (1 << bits)).alias("p")), contexts.select("context", "gamma")
    suffix = F.col("key").bitwiseAND((1 << (bits * (k - 1))) - 1).alias("_suffix")
    joined = own.select("key", kept.alias("kept"), "gamma", suffix).join(lower.select(F.col("key").alias("_suffix"), F.col("p").alias("below")), "_suffix")
    return joined.select("key", (F.col("kept") + F.col("gamma") * F.col("below")).alias("p")), contexts.select("context", "gamma")


def _orders(counts: DataFrame, order: int, bits: int) -> dict[int, DataFrame]:
    """``key, n`` by order: counts in the highest, distinct left neighbours in the others."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << (bits * k)) - 1).alias("key")
        levels[k] = written(levels[k + 1].groupBy(suffix).agg(F.count("*").alias("n")), "counts")
    return levels


def model(counts: DataFrame, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """Rows ``part, k, key, value``: log probabilities of n-grams (part ``p``) and log back-off
    weights of contexts (part ``g``), for orders 1 to ``order``; ``bits``: of the alphabet that made the keys.
    """
    counts = written(counts.select("key", "n"), "counts")
    levels = _orders(counts, order, bits)
    parts: list[DataFrame] = []
    p = None
    for k in range(1, order + 1):
        p, gamma = _level(levels[k].select("key", "n"), p, k, bits)
        p = written(p, "level")
        parts.extend([_rows(p, "p", k, "key", "p"), _rows(gamma, "g", k, "context", "gamma")])
    return written(reduce(DataFrame.union, parts), "model")


def _rows(df: DataFrame, part: str, k: int, key: str, value: str) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.lit(k).alias("k"), F.col(key).alias("key"), F.log(value).cast("float").alias("value"))


class Table:
    """Longs to floats by open addressing, looked up an array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(3 * len(keys) + 2)))))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, one stays
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and whether each key is there."""
        at = self._slot(keys)
        there = self.keys[at]
        found = there == keys
        out = np.where(found, self.values[at], np.float32(0))
        left = np.nonzero(~found & (there != -1))[0]
        while len(left):
            at_left = (at[left] + 1) & (len(self.keys) - 1)
            at[left] = at_left
            there = self.keys[at_left]
            hit = there == keys[left]
            out[left[hit]] = self.values[at_left[hit]]
            found[left[hit]] = True
            left = left[~hit & (there != -1)]
        return out, found


class Scorer:
    """Log probabilities of positions under one model."""

    def __init__(self, rows: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER, bits: int = BITS) -> None:
        self.order, self.bits = order, bits
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.float32))
        self.p, self.g = ({k: Table(*rows.get((part, k), nothing)) for k in range(1, order + 1)} for part in "pg")

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        left = np.arange(len(keys))
        for k in range(self.order, 0, -1):
            part = keys[left] & ((1 << (self.bits * k)) - 1)
            value, found = self.p[k].get(part)
            out[left] += value
            left, part = left[~found], part[~found]
            if not len(left):
                return out
            out[left] += self.g[k].get(part >> self.bits)[0]
        out[left] -= np.float32(self.bits * np.log(2))
        return out


def _shard(context: Column, shards: int, bits: int) -> Column:
    return F.pmod(F.shiftright(context.bitwiseAND((1 << (2 * bits)) - 1) * 40503, 8), F.lit(shards))


def collected(model_rows: DataFrame, n: int = 1, s: int = 0, bits: int = BITS) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Shard ``s`` of ``n`` of a model: keys and values by part and order."""
    context = F.when(F.col("part").startswith("p"), F.shiftright("key", bits)).otherwise(F.col("key"))
    got = (model_rows if n == 1 else model_rows.where((F.col("k") < 3) | (_shard(context, n, bits) == s))).toArrow()
    if not got.num_rows:
        return {}
    part = got.column("part").combine_chunks().dictionary_encode()
    names, at = part.dictionary.to_pylist(), part.indices.to_numpy(zero_copy_only=False)
    k, key, value = (got.column(c).to_numpy() for c in ("k", "key", "value"))
    masks = {(name, int(o)): (at == i) & (k == o) for i, name in enumerate(names) for o in np.unique(k)}
    return {which: (key[m], value[m]) for which, m in masks.items() if m.any()}


SUMS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.ArrayType(T.DoubleType()))])


def log_likelihoods(docs: DataFrame, models: list[DataFrame], letters: Alphabet, text_col: str = "text", keep: list[str] | None = None, lower: bool = False, order: int = ORDER, max_shard_rows: int = 3_000_000) -> DataFrame:
    """Rows of ``docs`` with ``n_tokens`` (characters) and ``log_likelihood``, natural, one for each model."""
    context = docs.sparkSession.sparkContext
    alpha = context.broadcast(letters)
    n = max(1, -(-sum(m.count() for m in models) // max_shard_rows))
    if n == 1:
        tables = context.broadcast([collected(m, 1, 0, letters.bits) for m in models])
        return arrow_map(docs, lambda: _sums(alpha, tables, 1, 0, lower, order), {"text": text_col}, SUMS, keep)

    def one(s: int):
        def run(texts: DataFrame) -> DataFrame:
            tables = context.broadcast([collected(m, n, s, letters.bits) for m in models])
            return arrow_map(texts, lambda: _sums(alpha, tables, n, s, lower, order), {"text": "text"}, SUMS, ["_text_hash"])

        return run

    total = F.array(*(F.sum(F.col("log_likelihood")[i]) for i in range(len(models)))).alias("log_likelihood")
    kept = [c for c in dict.fromkeys(docs.columns if keep is None else keep) if c not in SUMS.names]
    return in_passes(docs, text_col, kept, (one(s) for s in range(n)), [F.first("n_tokens").alias("n_tokens"), total])


def _sums(alpha, tables, n: int, s: int, lower: bool, order: int):
    bits = alpha.value.bits
    scorers = [Scorer(rows, order, bits=bits) for rows in tables.value]

    def step(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        sums = np.zeros((len(texts), len(scorers)))
        for keys, doc, _ in alpha.value.keys(texts, lower, order):
            if n > 1:
                mine = ((((keys >> bits) & ((1 << (2 * bits)) - 1)) * 40503) >> 8) % n == s
                keys, doc = keys[mine], doc[mine]
            for i, scorer in enumerate(scorers):
                sums[:, i] += np.bincount(doc, scorer.log_p(keys), len(texts))
        lengths = [len(fold(t, lower)) for t in texts]
        return {"n_tokens": pa.array(lengths, pa.int64()), "log_likelihood": pa.array(sums.tolist(), pa.list_(pa.float64()))}, None

    return step
