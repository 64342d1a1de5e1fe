"""Phrase collocations: frequent word sequences, scored by their weakest cut.

Phrases grow level by level, as Apriori has it: a sequence of ``m`` words can only be frequent if its first
``m - 1`` and its last ``m - 1`` words are.  So at each level only the places where both are frequent are looked at.

*A level.*  Tasks sum the keys of such places over their slices and send them in packed blocks to shards of their hashes,
which keep the keys that reach the least count: the candidates.  A minimal perfect hash of the candidates, in
shards of bounded size, with the keys stored for verification, goes to all tasks; each task turns its places into slots,
counts them with ``bincount`` into one array, and the arrays are summed by a tree of groups.  The same pass writes the places
as slots, from which the next level takes its keys: the slot of the first words and that of the last word make a
64-bit key without collisions.  (Words themselves are known by 64-bit hashes of language and bytes.)  Runs too short to hold a
longer phrase are left out, so levels shrink.

*Cuts.*  A phrase carries the counts of its beginnings and of its ends, read from the slots of its first and its last words,
so the parts of every cut are at hand.  Scores are exact decimals.

*Scale.*  Texts are read once; later passes read slots.  A block of pre-summed keys has up to ``HELD`` keys, so a
frequent sequence costs a number for each block, whichever share of the corpus has it.  Nothing but numbers of keys
and one shard of a perfect hash at a time comes to the driver.  A level of several shards is passed once for each.
Rankings are cut within parts of a language first.

Words are the runs of ``[^\\x20\\x09]`` of the pieces between ``[.,;:!?\\x0A-\\x0D]``, after A-Z are lower-cased.

Defined cases: null, empty and wordless texts have no words; a null language is ``und``; repeated rows count
each; words of any length are words; ties of the score go to the more frequent and then to the phrase that comes first in UTF-8;
an empty table gives no rows; other columns, whatever their names, are not looked at.  More than ``2**32`` candidates a level are an error.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm.packing import counts_of, keys_of, packed_counts, packed_keys
from tallyrill.llm.perfect_hash import PerfectHash
from tallyrill.llm.shared import discard, mapped, pick, utf8, written
from tallyrill.llm.shingles import LONG, PIECE, Spans, mixed

#: Distinct keys that a task holds before it sends them, places a shard of keys, and keys of a perfect hash.
HELD, PLACES, KEYS = 1 << 20, 1 << 20, 1 << 21
#: Counters of a row of the tree, and rows that one of its groups adds up.
CHUNK, FAN = 1 << 13, 32
BREAK = b"\n"
#: Characters between pieces become a newline, the other whitespace a space, A-Z become a-z.
FOLD = bytes(c | 0x20 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?" or 0x0A <= c <= 0x0D else 0x20 if c == 9 else c for c in range(256))
FLAT = bytes(0x20 if c == 0x0A else c for c in range(256))
NONE = np.uint32(0xFFFFFFFF)

ENCODED = "slice long, names array<string>, totals array<long>, keys binary, owner binary, words binary, codes binary"
SLICE, COUNTS, WORD = 0, 1, 2
CODED = f"kind int, number long, part int, p binary, z binary, new binary, name string, word string, {ENCODED}"


class Tokens:
    """Words of a folded text in order: hashes, where they lie in ``raw``, and whether a break comes before."""

    def __init__(self, raw: bytes) -> None:
        self.raw, found, at, pending = raw, [], 0, True
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            if end < len(raw):
                end = max(raw.rfind(b" ", at + 1, end), raw.rfind(BREAK, at + 1, end))
                if end < 0:  # one word that is longer
                    ends = [e for e in (raw.find(b" ", at + 1), raw.find(BREAK, at + 1)) if e >= 0]
                    end = min(ends, default=len(raw))
            part = self._long(at, end) if end - at > PIECE else self._short(at, end)
            *words, first, last = part
            if len(words[0]):
                words[3][0] |= pending
                found.append(words)
                pending = last
            else:
                pending |= first
            at = end
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.hashes, self.start, self.end, self.breaks = (np.concatenate([e, *(f[i] for f in found)]) for i, e in enumerate(empty))

    def _short(self, at: int, end: int):
        piece = b" " + self.raw[at:end] + b" "
        spans = Spans(piece.translate(FLAT))
        seen = np.concatenate([[0], np.cumsum(np.frombuffer(piece, np.uint8) == 0x0A)])
        before = np.diff(seen[spans.start], prepend=0) > 0
        left = bool(seen[-1] > (seen[spans.start[-1]] if len(spans.start) else 0))
        return spans.hashes(spans.start, spans.end), spans.start - 1 + at, spans.end - 1 + at, before, left, left

    def _long(self, at: int, end: int):
        """A single word, with a separator before it unless the text begins there."""
        sep = self.raw[at : at + 1] in (b" ", BREAK)
        start = at + sep
        digest = np.frombuffer(hashlib.blake2b(self.raw[start:end], digest_size=8).digest(), np.uint64)
        return digest, np.array([start]), np.array([end]), np.array([self.raw[at : at + 1] == BREAK]), False, False


def _language(name: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(name.encode(), digest_size=8).digest(), np.uint64)[0]


def _grouped(texts: list[bytes | None]) -> Iterator[tuple[list[int], bytes, list[int]]]:
    """Folded texts of up to a piece together: their numbers, the bytes, and where each begins."""
    group: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush():
        starts = list(accumulate((len(p) + 1 for p in parts), initial=1))[:-1]
        return group, BREAK + BREAK.join(parts) + BREAK, starts

    for i, text in enumerate(texts):
        line = (text or b"").translate(FOLD)
        if group and size + len(line) > LONG:
            yield flush()
            group, parts, size = [], [], 0
        group.append(i)
        parts.append(line)
        size += len(line) + 1
    if group:
        yield flush()


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, as the higher bytes of most are 0 and compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _ids(raw: bytes | None) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw or b"", np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _slice(texts: list[int], raw: bytes, starts: list[int], langs: list[str]) -> tuple:
    """A row of ``ENCODED`` but its number: distinct words, frequent ones first, with their bytes, and the places as numbers of words
    from 1, with 0 for breaks."""
    found = Tokens(raw)
    names = sorted({langs[i] for i in texts})
    of_text = np.array([names.index(langs[i]) for i in texts])
    owner = of_text[np.searchsorted(starts, found.start, "right") - 1] if len(found.start) else np.zeros(0, np.int64)
    hashes = mixed(found.hashes + np.array([_language(n) for n in names], np.uint64)[owner])
    keys, first, word, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((keys, -np.log2(often).astype(int)))
    keys, first, word = keys[order], first[order], np.argsort(order)[word]
    codes = np.zeros(len(word) + int(found.breaks.sum()), np.uint32)
    codes[np.arange(len(word)) + np.cumsum(found.breaks)] = word + 1
    words = BREAK.join(raw[s:e] for s, e in zip(found.start[first].tolist(), found.end[first].tolist(), strict=True))
    return names, np.bincount(owner, minlength=len(names)).tolist(), packed_keys(keys), _planes(owner[first]), words, _planes(codes)


def encoded(rows: DataFrame) -> DataFrame:
    """Slices of ``lang, text`` as numbers of words."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for group in _grouped(utf8(batch.column(1))):
                row = (number, *_slice(*group, langs))
                kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names=["slice", "names", "totals", "keys", "owner", "words", "codes"])
                number += 1

    return mapped(rows.select("lang", "text"), run, ENCODED)


def _keys_and_counts(row: dict, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the places of a slice, and how often they occur."""
    if level == 1:
        keys = keys_of(row["keys"])
        return keys, np.bincount(_ids(row["codes"]), minlength=len(keys) + 1)[1:]
    _, keys = _pairs(row)
    return np.unique(keys, return_counts=True)


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase one word longer may be, and its key: the first words' slot, and the last word's."""
    p, z = _ids(row["p"]), _ids(row["z"] or row["p"])
    at = np.flatnonzero((p[:-1] != NONE) & (p[1:] != NONE))
    return at, p[at].astype(np.uint64) << np.uint64(32) | z[at + 1]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], homes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and a slice that has each."""
    known, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return known, np.bincount(at, np.concatenate(counts), len(known)).astype(np.int64), np.concatenate(homes)[first]


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def candidates(slices: DataFrame, level: int, places: int, least: int) -> DataFrame:
    """``n, keys, homes``: blocks of those that occur ``least`` times or more; of words also the number of a slice that has each."""
    shards = max(1, -(-places // PLACES))
    columns = ["slice", "keys", "codes"] if level == 1 else ["p", "z"]

    def blocks(keys: np.ndarray, counts: np.ndarray, homes: np.ndarray) -> pa.RecordBatch:
        to = _shard_of(keys, shards)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
        parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        rows = [(int(to[p[0]]), packed_keys(keys[p]), packed_counts(counts[p]), homes[p].tobytes() if level == 1 else None) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "counts", "homes"])

    def send(batches):
        held, size = ([], [], []), 0
        for batch in batches:
            for row in batch.to_pylist():
                k, c = _keys_and_counts(row, level)
                for into, x in zip(held, (k, c, np.full(len(k), row.get("slice", 0))), strict=True):
                    into.append(x)
                size += len(k)
                if size > HELD:
                    found = _summed(*held)
                    if 2 * len(found[0]) > HELD:
                        yield blocks(*found)
                        held, size = ([], [], []), 0
                    else:
                        held, size = tuple([x] for x in found), len(found[0])
        if size:
            yield blocks(*_summed(*held))

    def reach(table: pa.Table) -> pa.Table:
        keys = [keys_of(k) for k in table["keys"].to_pylist()]
        counts = [counts_of(c, len(k)) for c, k in zip(table["counts"].to_pylist(), keys, strict=True)]
        homes = [np.frombuffer(h, "<i8") if h is not None else np.zeros(len(k), np.int64) for h, k in zip(table["homes"].to_pylist(), keys, strict=True)]
        known, total, home = _summed(keys, counts, homes)
        often = total >= least
        return pa.table({"n": pa.array([int(often.sum())], pa.int64()), "keys": pa.array([packed_keys(known[often])], pa.binary()), "homes": pa.array([home[often].tobytes()], pa.binary())})

    sent = mapped(slices.select(*columns), send, "shard int, keys binary, counts binary, homes binary")
    return sent.groupBy("shard").applyInArrow(reach, "n long, keys binary, homes binary")


def hashed(keys: DataFrame, shards: int) -> DataFrame:
    """``shard, n, hash``: a perfect hash of each shard of the blocks of keys."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.concatenate([keys_of(k) for k in table["keys"].to_pylist()])
        made = PerfectHash(keys)
        homes = np.empty(len(keys), np.int64)
        homes[made.slots(keys)] = np.concatenate([np.frombuffer(h, "<i8") for h in table["homes"].to_pylist()])
        return pa.table({"shard": table["shard"].slice(0, 1), "n": pa.array([len(keys)], pa.int64()), "hash": pa.array([pickle.dumps((made, homes))], pa.binary())})

    def dealt(batches):
        for batch in batches:
            for raw, homes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, home = keys_of(raw), np.frombuffer(homes, "<i8")
                to = _shard_of(keys, shards)
                known = np.unique(to).tolist()
                columns = (pa.array(known, pa.int32()), *(pa.array([f(x[to == i]) for i in known], pa.binary()) for f, x in ((packed_keys, keys), (np.ndarray.tobytes, home))))
                yield pa.RecordBatch.from_arrays([*columns], names=["shard", "keys", "homes"])

    return mapped(keys.select("keys", "homes"), dealt, "shard int, keys binary, homes binary").groupBy("shard").applyInArrow(build, "shard int, n long, hash binary")


def tree_sum(counts: DataFrame) -> DataFrame:
    """The sums of the arrays ``data`` of a ``part``; ``number`` is the task that made one."""

    def add(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(d, "<i8") for d in table["data"].to_pylist()))
        return pa.table({"part": table["part"].slice(0, 1), "number": table["number"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, number long, data binary"
    some = counts.withColumn("number", F.pmod("number", F.lit(FAN)))
    return some.groupBy("part", "number").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema).select("part", "data")


def _coded(slices: DataFrame, level: int, shared, offset: int, last: bool, longest: bool) -> DataFrame:
    """Places as slots from ``offset`` on of one shard's perfect hash (unless they are of the ``longest`` phrases), the counts
    of the slots, and at level 1 the words."""
    columns = ["slice", "names", "totals", "owner", "words", "keys", "codes", "new"] if level == 1 else ["p", "z", "new"]

    def out(**columns) -> pa.RecordBatch:
        kinds = dict.fromkeys(("p", "z", "new", "keys", "owner", "words", "codes"), pa.binary()) | {"name": pa.string(), "word": pa.string(), "names": pa.list_(pa.string()), "totals": pa.list_(pa.int64())}
        kinds = {n: kinds.get(n) or (pa.int64() if n in ("number", "slice") else pa.int32()) for n in (c.split()[0] for c in CODED.split(", "))}
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in kinds.items()], names=list(kinds))

    def run(batches):
        table, homes = shared.value
        counts = np.zeros(len(table.keys), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if level == 1:
                    codes = _ids(row["codes"])
                    slots = table.slots(keys_of(row["keys"]))
                    known = slots >= 0
                    counts[slots[known]] += np.bincount(codes, minlength=len(slots) + 1)[1:][known]
                    fresh = np.flatnonzero(known)[homes[slots[known]] == row["slice"]].tolist()  # a word is told once
                    if fresh:
                        words, owner = row["words"].split(BREAK), _ids(row["owner"])
                        yield out(kind=[WORD] * len(fresh), number=(slots[fresh] + offset).tolist(), name=[row["names"][owner[i]] for i in fresh], word=[words[i].decode("utf-8", "replace") for i in fresh])
                    own = np.full(len(slots) + 1, NONE)
                    own[1:][known] = slots[known] + offset
                    found, at, size = own[codes], slice(None), len(codes)
                else:
                    at, keys = _pairs(row)
                    slots = table.slots(keys)
                    counts += np.bincount(slots[slots >= 0], minlength=len(counts))
                    found = np.where(slots >= 0, slots + offset, NONE).astype(np.uint32)
                    size = len(_ids(row["p"]))
                new = _ids(row["new"]).copy() if row["new"] is not None else np.full(size, NONE)
                new[at] = np.minimum(new[at], found)  # a key is in one shard
                if longest:
                    continue
                if not last:
                    yield out(kind=[SLICE], **{c: [row[c]] for c in columns if c != "new"}, new=[_planes(new)])
                    continue
                z = new if level == 1 else np.concatenate([_ids(row["z"] or row["p"])[1:], [NONE]]).astype(np.uint32)
                here = np.concatenate([[False], new != NONE, [False]])
                long = here[1:-1] & (here[:-2] | here[2:])  # alone it makes no longer phrase
                keep = long | np.concatenate([[False], long[:-1]])  # with the place after a run, as its end
                ends = ~long[keep]
                if long.any():
                    p, z = new[keep], z[keep]
                    p[ends] = NONE
                    yield out(kind=[SLICE], p=[_planes(p)], z=[None if level == 1 else _planes(z)], new=[None])
        base = TaskContext.get().partitionId()
        parts = [i for i in range(0, len(counts), CHUNK) if counts[i : i + CHUNK].any()]
        if parts:
            yield out(kind=[COUNTS] * len(parts), number=[base] * len(parts), part=[i // CHUNK for i in parts], p=[counts[i : i + CHUNK].tobytes() for i in parts])

    return mapped(slices.select(*columns), run, CODED)


def _slots(hashes: DataFrame, sums: DataFrame, offset: int) -> DataFrame:
    """``id, key, a`` of every slot of one shard."""

    def run(one: pa.Table, parts: pa.Table) -> pa.Table:
        keys = pickle.loads(one["hash"][0].as_py())[0].keys
        counts = np.zeros(len(keys), np.int64)
        for part, data in zip(parts["part"].to_pylist(), parts["data"].to_pylist(), strict=True):
            counts[part * CHUNK : (part + 1) * CHUNK] = np.frombuffer(data, "<i8")
        return pa.table({"id": np.arange(len(keys)) + offset, "key": keys.view(np.int64), "a": counts})

    one = lambda df: df.withColumn("_g", F.lit(0)).groupBy("_g")  # noqa: E731  a shard is of bounded size
    return one(hashes.select("hash")).cogroup(one(sums)).applyInArrow(run, "id long, key long, a long")


def counted(slices: DataFrame, level: int, places: int, least: int, longest: bool) -> tuple[DataFrame | None, DataFrame | None, list[DataFrame]]:
    """One level: ``id, key, a`` of its candidates (None where there is none), at level 1 ``id, lang, word``, and the passes' tables, of which the last has the slices."""
    spark = slices.sparkSession
    keys = written(candidates(slices, level, places, least), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    if not total:
        discard(keys)
        return None, None, []
    if total >= int(NONE):
        raise ValueError(f"{total} candidates of {level} words")
    hashes = written(hashed(keys, -(-total // KEYS)), "hashes")
    sizes = {r["shard"]: r["n"] for r in hashes.select("shard", "n").collect()}
    now, offset, found, words = slices.withColumn("new", F.lit(None).cast("binary")), 0, [], []
    made: list[DataFrame] = []
    for i, (shard, n) in enumerate(sorted(sizes.items())):
        own = hashes.where(F.col("shard") == shard)
        shared = spark.sparkContext.broadcast(pickle.loads(own.first()["hash"]))
        coded = written(_coded(now, level, shared, offset, i == len(sizes) - 1, longest), "coded")
        sums = tree_sum(coded.where(F.col("kind") == COUNTS).select("part", "number", F.col("p").alias("data")))
        found.append(written(_slots(own, sums, offset), "slots"))
        words.append(coded.where(F.col("kind") == WORD).select(F.col("number").alias("id"), F.col("name").alias("lang"), "word"))
        made.append(coded)
        offset += n
        now = coded.where(F.col("kind") == SLICE)
        shared.unpersist()
    discard(keys, hashes)
    return reduce(DataFrame.union, found), reduce(DataFrame.union, words) if level == 1 else None, made


def _phrases(slots: DataFrame, below: DataFrame) -> DataFrame:
    """A level's phrases from the level below: the counts of their beginnings and of their ends, by length."""
    named = slots.select("id", F.shiftrightunsigned("key", 32).alias("prefix"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("last"), "a")
    begin = below.select(F.col("id").alias("prefix"), "lang", "phrase", "heads", F.col("suffix").alias("_middle"))
    end = below.select(F.col("id").alias("suffix"), F.col("prefix").alias("_middle"), "last", "last_word", "tails")
    joined = named.join(begin, "prefix").join(end, ["_middle", "last"])
    grown = lambda c: F.concat(c, F.array("a")).alias(c)
    return joined.select("id", "prefix", "suffix", "last", "lang", F.concat_ws(" ", "phrase", "last_word").alias("phrase"), "last_word", grown("heads"), grown("tails"), "a")


def _scored(phrases: DataFrame, words: int) -> DataFrame:
    """The cut with the lowest score: ``l, r, score``."""
    cuts = []
    for k in range(1, words):
        left, right = f"heads[{k - 1}]", f"tails[{words - k - 1}]"
        score = F.expr(f"CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0)) div (CAST({left} AS DECIMAL(20, 0)) + CAST({right} AS DECIMAL(20, 0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r")))
    best = F.array_min(F.array(*cuts))
    return phrases.select("id", "lang", "phrase", "a", best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score"))


def _kept(scored: DataFrame, longer: DataFrame | None, share: int) -> DataFrame:
    """Without those that a phrase one word longer covers; what a still longer one covers, that one does as well."""
    if longer is None:
        return scored
    inside = longer.select(F.col("prefix").alias("id"), "a").union(longer.select("suffix", "a")).groupBy("id").agg(F.max("a").alias("_most"))
    wide = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n).cast("decimal(5,0)")
    covered = wide("_most", 100) >= wide("a", share)
    return scored.join(inside, "id", "left").where(~F.coalesce(covered, F.lit(False))).drop("_most")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, share: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of its weakest cut, ``n`` the language's words; phrases that a longer candidate
    holds with ``share`` hundredths of their count are left out."""
    rows = pick(docs, {"text": text_col, "lang": lang_col}).select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    slices = written(encoded(rows), "slices")
    totals = written(slices.select(F.explode(F.arrays_zip("names", "totals")).alias("t")).groupBy(F.col("t.names").alias("lang")).agg(F.sum("t.totals").alias("n")), "totals")
    places = totals.agg(F.sum("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tables = [slices]
    for m in range(1, longest + 1):
        slots, words, made = counted(slices, m, places, least, m == longest)
        if slots is None:
            break
        if m == 1:
            one = slots.select("id", "a").join(words, "id")
            none = F.lit(0).cast("long")  # a word has no words before its last, nor after its first
            found = one.select("id", none.alias("prefix"), none.alias("suffix"), F.col("id").alias("last"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), F.array("a").alias("heads"), F.array("a").alias("tails"), "a")
        else:
            found = _phrases(slots, levels[-1])
        levels.append(written(found, "phrases"))
        discard(*tables)
        tables = made
        slices = made[-1].where(F.col("kind") == SLICE).select("p", "z")
    discard(*tables)
    parts = [_kept(_scored(p, m), longer, share) for m, (p, longer) in enumerate(zip(levels, [*levels[1:], None], strict=False), 1) if m > 1]
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    every = reduce(DataFrame.union, parts).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
