"""LM scoring by cross-entropy difference: a target model against a background model.

Both models are matched: bigrams of words, one vocabulary (every word of the corpus), the same
smoothing.  The background model counts every document, the target model the documents labelled
as target; each document is scored by its loss per token under either model, and by their
difference: below 0, a document is closer to the target than to the corpus at large.

*Held out.*  A document is scored by what the other documents say: its own counts are taken out of both
models first.  So a target document has no advantage by having been counted, and a document that occurs twice
stands out, as its copy still counts.

*Smoothing.*  With counts ``c`` and ``n`` tokens in all, ``V`` words in the vocabulary:
``p(w) = (c(w) + 1) / (n + V + 1)`` and ``p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu)``; a text begins with a
boundary that counts as a word before the first.  What ``c(v)`` holds beyond its bigrams is the text's end.

*Scale.*  Nothing but five sums comes to the driver: the counts grow with the corpus.  Documents are packed into
slices of some megabytes, rows of a written table with a row group for every one or two, so that a task never holds more of them.  Each slice sends its distinct words and bigrams,
packed by shard of their hashes; a shard adds up what all slices sent and answers every slice with the totals alone, in the order of its request; then slices meet their
answers and are scored.  Rows are blocks, not n-grams, so a frequent word costs as many numbers as there
are slices.  Slices and shards grow with the square root of the text (from ``SLICE`` and ``SHARD`` to ``GROWN`` times that), so the blocks, a
row for each slice and shard, grow as the text does; beyond that growth they grow faster, but are never more than the n-grams that a plain
grouping would send.  Words are known by 64-bit hashes.  Texts are not shuffled: the ids of targets are broadcast where they are
at most ``TARGETS``; beyond, rows with an id are joined by sorting.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased, and each ideograph, kana, hangul syllable
and the like is a word of its own.

Defined cases: null and blank texts have no tokens and null losses; an id with several
labels is a target if one of them says so; null ids are never targets; without any target
document the target model knows nothing and gives the same loss to every word.  Repeated rows count and are scored each;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.llm.packing import counts_of, keys_of, packed_counts, packed_keys
from tallyrill.llm.shared import discard, mapped, pick, utf8, written
from tallyrill.llm.shingles import pair_hashes, word_groups

#: Bytes of text a slice and a shard while the text is small, how far they grow, and the size of text from which they do.
SLICE, SHARD, GROWN, SMALL = 8 << 20, 16 << 20, 4, 16 << 30
#: Most ids of target documents that are broadcast.
TARGETS = 2_000_000
#: Weight of the unigram in a bigram's probability.
MU = 10.0
#: Scripts written without spaces.
LONE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b2ff\U00020000-\U0003ffff]")
WORD, PAIR, TEXT = 1, 2, 0
#: The boundary before a text.
START = np.uint64(0x9E3779B97F4A7C15)
REQUEST = "slice long, shard int, kind int, keys binary, n binary, f binary"
ANSWER = "slice long, shard int, kind int, n binary, f binary, types long, total long, flagged long"


def _spaced(text: bytes | None) -> bytes:
    if not text or text.isascii():
        return text or b""
    plain = text.decode("utf-8", "replace")
    return LONE.sub(lambda m: f" {m[0]} ", plain).encode() if LONE.search(plain) else text


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of their bigrams, the text of each, and each text's number of words."""
    lengths, parts = np.zeros(len(texts), np.int64), []
    for group, words, bounds in word_groups([_spaced(t) for t in texts]):
        parts.append(words)
        lengths[group] = [b - a for a, b in bounds]
    words = np.concatenate(parts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    before = np.concatenate([[START], words[:-1]]) if len(words) else words
    before[_first(owner)] = START
    return words, pair_hashes(before, words), owner, lengths


def _first(owner: np.ndarray) -> np.ndarray:
    """Where a text begins."""
    return np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)


def growth(size: int) -> float:
    """By how much slices and shards are larger for so many bytes of text."""
    return min(float(GROWN), max(1.0, (size / SMALL) ** 0.5))


def _slices(rows: DataFrame, size: int) -> DataFrame:
    """``slice, docs``: the rows ``doc_id, flag, text`` packed as they lie, a batch a slice."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            docs = pa.StructArray.from_arrays(batch.columns, names=["doc_id", "flag", "text"])
            yield pa.RecordBatch.from_arrays([pa.array([base + i], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)], names=["slice", "docs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows.select("doc_id", "flag", "text"), run, f"slice long, docs array<struct<doc_id:{kind},flag:boolean,text:string>>", int(SLICE * growth(size)))


def _unpacked(docs: pa.ListScalar) -> tuple[pa.Array, np.ndarray, list[bytes | None]]:
    ids, flags, texts = docs.values.flatten()
    return ids, flags.to_numpy(zero_copy_only=False).astype(bool), utf8(texts)


def _requests(slices: DataFrame, shards: int) -> DataFrame:
    """What each slice counts of its words and bigrams, in all and in target documents, by shard; its texts are kind ``TEXT``."""

    def run(batches):
        for batch in batches:
            for name, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, flags, texts = _unpacked(docs)
                words, pairs, owner, lengths = tokens(texts)
                some = lengths > 0
                out = [(name, 0, TEXT, packed_keys(np.array([START])), packed_counts(np.array([some.sum()])), packed_counts(np.array([flags[some].sum()])))]
                for kind, keys in ((WORD, words), (PAIR, pairs)):
                    known, at = np.unique(keys, return_inverse=True)
                    n, f = (np.bincount(x, minlength=len(known)) for x in (at, at[flags[owner]]))
                    to, start = np.unique(((known >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), return_index=True)
                    for shard, a, b in zip(to.tolist(), start, np.append(start[1:], len(known))[: len(start)], strict=True):
                        out.append((name, shard, kind, packed_keys(known[a:b]), packed_counts(n[a:b]), packed_counts(f[a:b])))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["slice", "shard", "kind", "keys", "n", "f"])

    return mapped(slices, run, REQUEST)


def _answers(table: pa.Table) -> pa.Table:
    """The totals of one shard, to every slice in the order of its ``types`` keys; slice -1 has the shard's sums."""
    table = table.combine_chunks()
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    out = []
    for kind in sorted(set(columns["kind"])):
        rows = [i for i, k in enumerate(columns["kind"]) if k == kind]
        parts = [keys_of(columns["keys"][i]) for i in rows]
        n, f = (np.concatenate([counts_of(columns[c][i], len(p)) for i, p in zip(rows, parts, strict=True)]) for c in "nf")
        if kind == TEXT:
            out.append((-1, 0, TEXT, None, None, None, int(n.sum()), int(f.sum())))
            continue
        known, at = np.unique(np.concatenate(parts), return_inverse=True)
        totals = [np.bincount(at, x, len(known)).astype(np.int64) for x in (n, f)]
        ends = np.cumsum([len(p) for p in parts])
        for i, a, b in zip(rows, (ends - [len(p) for p in parts]).tolist(), ends.tolist(), strict=True):
            out.append((columns["slice"][i], columns["shard"][i], kind, *(packed_counts(t[at[a:b]]) for t in totals), b - a, None, None))
        out.append((-1, columns["shard"][0], kind, None, None, len(known), int(n.sum()), int(f.sum())))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["slice", "shard", "kind", "n", "f", "types", "total", "flagged"])


def losses(texts: list[bytes | None], flags: np.ndarray, totals: dict[int, tuple[np.ndarray, np.ndarray]], sums: dict[str, int], mu: float = MU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and loss under the target and the background model, of each text; ``totals``: counts of the distinct words and bigrams, in order of their hashes."""
    words, pairs, owner, lengths = tokens(texts)
    first, target = _first(owner), flags[owner].astype(np.int64)

    def others(keys: np.ndarray, kind: int) -> list[np.ndarray]:
        """Counts of each position's key in other texts, of target texts and of all."""
        known, at = np.unique(keys, return_inverse=True)
        _, same, own = np.unique(owner * len(known) + at, return_inverse=True, return_counts=True)
        n, f = totals[kind]
        return [f[at] - own[same] * target, n[at] - own[same]]

    if not len(words):
        return lengths, np.zeros(len(texts)), np.zeros(len(texts))
    found = []
    texts_of = (sums["target_texts"] - target, sums["texts"] - 1)
    tokens_of = (sums["target_tokens"] - lengths[owner] * target, sums["tokens"] - lengths[owner])
    for one, two, begun, n in zip(others(words, WORD), others(pairs, PAIR), texts_of, tokens_of, strict=True):
        before = np.where(first, begun, np.concatenate([[0], one[:-1]]))
        p = (two + mu * (one + 1) / (n + sums["types"] + 1)) / (before + mu)
        found.append(np.bincount(owner, -np.log(p), len(texts)))
    return lengths, found[0], found[1]


def _scored(slices: DataFrame, answers: DataFrame, sums: dict[str, int], mu: float) -> DataFrame:
    gathered = answers.where("slice >= 0").groupBy("slice").agg(F.collect_list(F.struct("kind", "shard", "types", "n", "f")).alias("answers"))
    joined = slices.join(gathered.hint("merge"), "slice", "left").select("docs", "answers")

    def run(batches):
        for batch in batches:
            for docs, answers in zip(batch.column(0), batch.column(1), strict=True):
                ids, flags, texts = _unpacked(docs)
                blocks = sorted(answers.as_py() or [], key=lambda a: (a["kind"], a["shard"]))
                totals = {k: tuple(np.concatenate([np.zeros(0, np.int64), *(counts_of(a[c], a["types"]) for a in blocks if a["kind"] == k)]) for c in "nf") for k in (WORD, PAIR)}
                n, target, background = losses(texts, flags, totals, sums, mu)
                some = np.where(n > 0, n, 1)
                columns = [pa.array(x / some, pa.float64(), mask=n == 0) for x in (target, background, target - background)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    kind = slices.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    return mapped(joined, run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", target: int = 1, mu: float = MU, shard_bytes: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` (nats a token) for every row."""
    rows = pick(docs, {"doc_id": id_col, "text": text_col})
    chosen = pick(labels, {"_id": id_col, "_label": label_col}).where((F.col("_label") == target) & F.col("_id").isNotNull()).select("_id").distinct().withColumn("flag", F.lit(True))
    none = F.lit(False).alias("flag")
    if chosen.count() <= TARGETS:
        flagged = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("flag", none).alias("flag"), "text")
    else:  # labels grow with the corpus; rows without an id stay where they are
        known = rows.where("doc_id is not null").join(chosen.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
        flagged = known.select("doc_id", F.coalesce("flag", none).alias("flag"), "text").union(rows.where("doc_id is null").select("doc_id", none, "text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = written(_slices(flagged, size), "slices", int(SLICE * growth(size)))
    asked = _requests(slices, max(1, -(-size // int((shard_bytes or SHARD) * growth(size)))))
    answers = written(asked.groupBy("shard").applyInArrow(_answers, ANSWER), "answers")
    by = {r["kind"]: r for r in answers.where("slice = -1").groupBy("kind").agg(F.sum("types").alias("types"), F.sum("total").alias("total"), F.sum("flagged").alias("flagged")).collect()}
    of = lambda kind, c: int(by[kind][c] or 0) if kind in by else 0
    sums = {"texts": of(TEXT, "total"), "target_texts": of(TEXT, "flagged"), "tokens": of(WORD, "total"), "target_tokens": of(WORD, "flagged"), "types": of(WORD, "types")}
    scored = written(_scored(slices, answers, sums, mu), "scored")
    discard(slices, answers)
    return scored
