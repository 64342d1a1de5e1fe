"""Toxicity by class-conditional Kneser-Ney models.

A text is lower-cased and cut into words (ASCII letters and digits, and all bytes from 0x80; each ideograph, kana, hangul
syllable and the like is a word of its own, and two of them in a row are one more).  Two models, of toxic and of ordinary documents, predict each byte of a word,
and its end, from the word's beginning, up to ``DEPTH`` bytes; a longer word is read on in runs of ``RUN`` bytes, one from each
byte, predicted in the same way from the run's beginning, so what a long word says is heard wherever in it it stands.
A class counts in how many of its documents a beginning occurs (modified Kneser-Ney
discounts, interpolated); what the discounts free goes to one back-off model that both classes share, a
Kneser-Ney model (see ``ngram``) of order ``ORDER`` over the bytes of all words.  So an expression that
neither class knows has the same probability in both and speaks for neither, and one that shares its
beginning with known ones speaks as that does.  Two further models predict a word from the whole word before it, so that
expressions of several words count; their shared back-off is the share of words that
a word follows.  Beginnings of runs, and pairs, that occur in one document only are smoothing mass, and speak for neither class.

The log-likelihoods are compared length-normalised: the difference a word, over the whole text and over
its 1, 2 and 4 strongest words, as a text that insults twice in a thousand words must stand out, and that of pairs
over the whole text.  The evidence beyond ``MARKED`` nats a word, summed, and the number of words join them on a logarithmic scale.  A
logistic function of these seven, fitted on sampled documents that the models have not seen, gives the score.

The fit uses a bounded sample of labelled rows, the first by hash of their ids: at most
``max_toxic`` and ``max_ordinary``; 7 in 10 of each go to the models, the rest to the logistic
function.  The models go to the tasks in shards of at most ``max_shard_rows`` rows, dealt by a word's
or run's first two bytes and by the hash of a pair, and beyond one shard one at a time.

Defined cases: null and empty texts, and texts without a word, have ratios of 0 and the score that belongs to
them; with one class only in the sample, every score is that class's share (0 without labels);
a word beyond ``LONG`` bytes counts as several words; a pair that lies across two pieces of a very long text is seen as its words;
repeated rows are scored alike; an empty table gives no rows; a column named like one of the result gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm import ngram
from tallyrill.llm.cross_entropy import LONE
from tallyrill.llm.decontaminate import FOLD
from tallyrill.llm.samples import labelled
from tallyrill.llm.shared import arrow_map, discard, in_passes, mapped, pick, written
from tallyrill.llm.shingles import LONG, PIECE, Spans, pair_hashes

DEPTH, RUN, ORDER, MARKED, LIMIT = 12, 6, 5, 2.0, 12.0
#: Strongest words whose mean is taken, and how many are kept.
STRONGEST, TOP = (1, 2, 4), 4
FOUND = T.StructType([T.StructField("words", T.LongType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("sums", "top"))])
#: The beginnings of every word and of every run; what tells runs from words.
ROOT, RUNS, LATER = 0, 1, np.uint64(0xA5A5_1234_5EED_0F0F)


class Words:
    """The words of some texts, and the runs of those beyond ``DEPTH`` bytes, as parts: ``owner`` (the text of each), ``kind`` (a number for each
    distinct part, as far as ``DEPTH`` tells); ``pair`` and ``pair_owner`` are those of two words in a row."""

    def __init__(self, line: bytes, owners: list[int], ends: list[int]) -> None:
        self.spans = Spans(line)
        begin, length = self.spans.start, self.spans.end - self.spans.start + 1  # the end of a word is a byte of it
        owner = np.array(owners)[np.searchsorted(ends, begin, "right")]
        parts = 1 + np.maximum(length - DEPTH, 0)
        word = np.repeat(np.arange(len(begin)), parts)
        place = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        later = place > 0
        start, size = begin[word] + np.where(later, place + DEPTH - RUN, 0), np.where(later, RUN, np.minimum(length[word], DEPTH))
        same = owner[1:] == owner[:-1]
        lead, close = self.spans.raw[begin], np.diff(begin) <= 6
        lone = ((length == 4) & (lead >= 0xE0)) | ((length == 5) & (lead >= 0xF0))  # one character of a script without spaces
        both = np.flatnonzero(lone[:-1] & lone[1:] & same & close)
        self.owner = np.concatenate([owner[word], owner[both]])
        start, size = np.concatenate([start, begin[both]]), np.concatenate([size, (begin + length)[both + 1] - begin[both]])
        later = np.concatenate([later, np.zeros(len(both), bool)])
        hashes = self.spans.hashes(start, start + size) ^ (LATER * later)
        self.hash, first, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.start, self.size, self.later = start[first], size[first], later[first]
        whole = self.spans.hashes(begin, begin + length)
        self.pair, self.pair_owner = pair_hashes(whole[:-1], whole[1:])[same].view(np.int64), owner[1:][same]
        self.first, self.second = (w[same].view(np.int64) for w in (whole[:-1], whole[1:]))

    def beginnings(self, k: int, of: np.ndarray) -> np.ndarray:
        """Hashes of the first ``k`` bytes of the distinct parts ``of``."""
        return (self.spans.hashes(self.start[of], self.start[of] + k) ^ (LATER * self.later[of])).view(np.int64)

    def roots(self) -> np.ndarray:
        return (self.spans.hashes(self.start, self.start + np.minimum(self.size, 2)) ^ (LATER * self.later)).view(np.int64)

    def grams(self, k: int, of: np.ndarray) -> np.ndarray:
        """The last ``ORDER`` of the first ``k`` bytes, 8 bits each; 0 before the part."""
        out = np.zeros(len(of), np.int64)
        for j in range(min(ORDER, k)):
            out |= self.spans.raw[self.start[of] + k - 1 - j].astype(np.int64) << (8 * j)
        return out


def words(texts: list[str | None]) -> Iterator[Words]:
    """The words of all texts, about ``PIECE`` bytes at a time."""
    parts: list[bytes] = []
    owners: list[int] = []
    total = 0

    def made() -> Words:
        return Words(b" " + b" ".join(parts) + b" ", owners, (1 + np.cumsum([len(p) + 1 for p in parts])).tolist())

    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        if not lowered.isascii() and LONE.search(lowered):
            lowered = LONE.sub(r" \g<0> ", lowered)
        folded = lowered.encode("utf-8", "replace").translate(FOLD)
        while folded:
            part, folded = folded[:LONG], folded[LONG:]
            if folded and (cut := part.rfind(b" ")) > 0:
                part, folded = part[:cut], part[cut + 1 :] + folded
            if total + len(part) > PIECE:
                yield made()
                parts, owners, total = [], [], 0
            parts.append(part)
            owners.append(i)
            total += len(part) + 1
    if parts:
        yield made()


# --- the models ---------------------------------------------------------------------------


def counted(sample: DataFrame) -> DataFrame:
    """``key, parent, gram, root, toxic, ordinary`` by beginning of a word, from ``text`` and ``flag``: in how many documents of each class."""

    def run(batches):
        for batch in batches:
            flags = np.array([bool(f) for f in batch.column(1).to_pylist()])
            for group in words(batch.column(0).to_pylist()):
                met = np.unique(group.owner.astype(np.int64) * len(group.hash) + group.kind)  # a word once a document
                owner, kind = met // len(group.hash), met % len(group.hash)
                toxic, ordinary = (np.bincount(kind, w, len(group.hash)).astype(np.int64) for w in (flags[owner], ~flags[owner]))
                parent, root = np.where(group.later, RUNS, ROOT), group.roots()
                for k in range(1, DEPTH + 1):
                    at = np.flatnonzero(group.size >= k)
                    if not len(at):
                        break
                    key, first, same = np.unique(mine := group.beginnings(k, at), return_index=True, return_inverse=True)
                    sums = [np.bincount(same, c[at], len(key)).astype(np.int64) for c in (toxic, ordinary)]
                    place = root[at][first] if k > 1 else np.full(len(key), ROOT, np.int64)
                    columns = (key, parent[at][first], group.grams(k, at)[first], place, *sums, group.later[at][first])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "parent", "gram", "root", "toxic", "ordinary", "later"])
                    parent[at] = mine

    got = mapped(pick(sample, {"t": "text", "f": "flag"}), run, "key long, parent long, gram long, root long, toxic long, ordinary long, later long")
    return got.groupBy("key").agg(*(F.min(c).alias(c) for c in ("parent", "gram", "root", "later")), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def counted_pairs(sample: DataFrame) -> DataFrame:
    """``key, first, second, toxic, ordinary`` by two words in a row: in how many documents of each class."""

    def run(batches):
        for batch in batches:
            flags = np.array([bool(f) for f in batch.column(1).to_pylist()])
            for group in words(batch.column(0).to_pylist()):
                key, first, kind = np.unique(group.pair, return_index=True, return_inverse=True)
                met = np.unique(group.pair_owner.astype(np.int64) * max(1, len(key)) + kind)
                owner, kind = met // max(1, len(key)), met % max(1, len(key))
                sums = [np.bincount(kind, w, len(key)).astype(np.int64) for w in (flags[owner], ~flags[owner])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, group.first[first], group.second[first], *sums)], names=["key", "first", "second", "toxic", "ordinary"])

    got = mapped(pick(sample, {"t": "text", "f": "flag"}), run, "key long, first long, second long, toxic long, ordinary long")
    return got.groupBy("key").agg(F.min("first").alias("first"), F.min("second").alias("second"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _smoothed(counts: DataFrame, context: str) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """By context: the classes' totals and what their discounts free; the columns of a class's discounted share and of its freed share."""
    classes = ("toxic", "ordinary")
    seen = counts.agg(*(F.count_if(F.col(c) == i) for c in classes for i in (1, 2, 3, 4))).first()
    cuts = {c: ngram._discounts(*seen[4 * j : 4 * j + 4]) for j, c in enumerate(classes)}
    cut = {c: ngram._by_count(F.col(c), cuts[c]) for c in classes}
    free = counts.groupBy(context).agg(*(F.sum(c).alias(f"all_{c}") for c in classes), *(F.sum(cut[c]).alias(f"cut_{c}") for c in classes))
    gamma = {c: F.when(F.col(f"all_{c}") > 0, F.col(f"cut_{c}") / F.col(f"all_{c}")).otherwise(1.0) for c in classes}
    free = free.select(context, *(F.col(f"all_{c}") for c in classes), *(gamma[c].alias(f"free_{c}") for c in classes))
    own = {c: F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - cut[c], F.lit(0.0)) / F.col(f"all_{c}")).otherwise(0.0) for c in classes}
    return free, own, {c: F.col(f"free_{c}") for c in classes}


def pair_model(counts: DataFrame) -> DataFrame:
    """``key, ratio``: log of toxic to ordinary probability of the second word after the first, of pairs in two documents or more."""
    counts = written(counts, "pairs")
    free, own, freed = _smoothed(counts, "first")
    followers = counts.groupBy("second").agg(F.count("*").alias("n"))  # of words, each once
    kinds = counts.count()
    known = counts.where(F.col("toxic") + F.col("ordinary") > 1).join(free, "first").join(followers, "second")
    p = {c: own[c] + freed[c] * F.col("n") / F.lit(float(max(1, kinds))) for c in own}
    found = written(known.select("key", F.log(p["toxic"] / p["ordinary"]).cast("float").alias("ratio")), "pair-ratios")
    discard(counts)
    return found


def model(counts: DataFrame) -> DataFrame:
    """``key, root, ratio, miss``: log of toxic to ordinary probability of a beginning's last byte after the
    rest of it, and of a byte that neither class has met after it (both beside the shared back-off)."""
    counts = written(counts, "beginnings")
    free, share, freed = _smoothed(counts, "parent")
    free = written(free, "contexts")
    grams = counts.groupBy(F.col("gram").alias("key")).agg(F.sum(F.col("toxic") + F.col("ordinary")).alias("n"))
    below = ngram.model(grams, ORDER, bits=8).where((F.col("part") == "p") & (F.col("k") == ORDER)).select(F.col("key").alias("gram"), F.exp("value").alias("below"))
    spoken = (F.col("later") == 0) | (F.col("toxic") + F.col("ordinary") > 1)  # not a run of one document
    own = counts.where(spoken).join(free, "parent").join(below, "gram")
    p = {c: share[c] + freed[c] * F.col("below") for c in share}
    steps = own.select("key", "root", F.log(p["toxic"] / p["ordinary"]).cast("float").alias("ratio"))
    misses = free.select(F.col("parent").alias("key"), F.log(F.col("free_toxic") / F.col("free_ordinary")).cast("float").alias("miss"))
    found = written(steps.join(misses, "key", "left").select("key", "root", "ratio", F.coalesce("miss", F.lit(0.0).cast("float")).alias("miss")), "toxicity")
    discard(counts, free)
    return found


class Ratios:
    """Log-likelihood ratios of words and of pairs under the rows of the models (of one shard)."""

    def __init__(self, key: np.ndarray, ratio: np.ndarray, miss: np.ndarray, pair: np.ndarray, pair_ratio: np.ndarray) -> None:
        self.at, self.ratio, self.miss = ngram.Table(key, np.arange(len(key), dtype=np.float32)), ratio, miss
        self.pairs = ngram.Table(pair, pair_ratio)

    def of(self, group: Words) -> np.ndarray:
        """Of each distinct part, toxic against ordinary, at most ``LIMIT``."""
        out = np.zeros(len(group.hash))
        alive, last = np.arange(len(out)), np.full(len(out), -1)
        for k in range(1, DEPTH + 1):
            alive = alive[group.size[alive] >= k]
            if not len(alive):
                break
            place, found = self.at.get(group.beginnings(k, alive))
            place = place.astype(np.int64)
            out[alive[found]] += self.ratio[place[found]]
            lost = alive[~found & (last[alive] >= 0)]
            out[lost] += self.miss[last[lost]]
            alive = alive[found]
            last[alive] = place[found]
        return np.minimum(out, LIMIT)

    def of_pairs(self, group: Words) -> np.ndarray:
        """Of each pair, 0 where it is not known."""
        value, found = self.pairs.get(group.pair)
        return np.where(found, np.minimum(value, LIMIT), 0.0).astype(float)


def _strongest(best: np.ndarray, owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The largest values by owner, beside those found before, as many as there were."""
    n, top = best.shape
    owner, value = np.concatenate([owner, np.repeat(np.arange(n), top)]), np.concatenate([value, best.ravel()])
    order = np.lexsort((-value, owner))
    owner, value = owner[order], value[order]
    start = np.searchsorted(owner, np.arange(n))
    return value[start[:, None] + np.arange(top)]


def _summed(tables, shards: int, shard: int):
    ratios = Ratios(*tables.value)

    def step(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        n = len(texts)
        count, sums, best = np.zeros(n), np.zeros((3, n)), np.zeros((n, TOP))
        for group in words(texts):
            owner, kind, value = group.owner, group.kind, ratios.of(group)
            pair_owner, pair = group.pair_owner, ratios.of_pairs(group)  # of another shard's pairs: 0
            if shards > 1:
                mine = (group.roots() % shards == shard)[kind]
                owner, kind = owner[mine], kind[mine]
            each = value[kind]
            count += np.bincount(owner, minlength=n)
            strong = each > 0
            for i, (o, v) in enumerate(((owner, each), (owner[strong], np.maximum(each[strong] - MARKED, 0)), (pair_owner, pair))):
                sums[i] += np.bincount(o, v, n)
            best = _strongest(best, owner[strong], each[strong])
        lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
        return {"words": pa.array(count.astype(np.int64)), "sums": lists(sums.T), "top": lists(best)}, None

    return step


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method; classes weigh the same. Weights, centre, scale."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-1] * (z.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (share * (p - y)) + ridge @ w
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w, centre, scale


class Detector:
    """A fitted detector; ``scored`` applies it."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 4000, max_ordinary: int = 6000, max_shard_rows: int = 3_000_000) -> None:
        self.id_col, self.text_col = id_col, text_col
        sample = written(labelled(docs, labels, label_col, {1: max_toxic, 0: max_ordinary}, id_col, text_col), "sample")
        fit = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10)) < 7
        learn = sample.where(fit).withColumn("flag", F.col("label") == 1)
        self.model, self.pairs = model(counted(learn)), pair_model(counted_pairs(learn))
        self.shards = max(1, -(-(self.model.count() + self.pairs.count()) // max_shard_rows))
        rest = self.ratios(sample.where(~fit), "text", ["label"]).toPandas()
        y = rest["label"].to_numpy(float)
        self.weights = None
        if 0 < y.sum() < len(y):
            self.weights, self.centre, self.scale = _logistic(np.array(rest["ratios"].tolist(), float), y)
        self.only = float(y.mean()) if len(y) else 0.0

    def _tables(self, shard: int):
        mine = (F.col("root") == ROOT) | (F.pmod("root", F.lit(self.shards)) == shard)
        got = (self.model if self.shards == 1 else self.model.where(mine)).toArrow()
        pairs = (self.pairs if self.shards == 1 else self.pairs.where(F.pmod("key", F.lit(self.shards)) == shard)).toArrow()
        tables = (*(got.column(c).to_numpy() for c in ("key", "ratio", "miss")), *(pairs.column(c).to_numpy() for c in ("key", "ratio")))
        return self.model.sparkSession.sparkContext.broadcast(tables)

    def ratios(self, docs: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
        """Rows of ``docs`` with ``ratios``: the means of the strongest words, of all and of all pairs, the marked evidence, the words."""
        n = self.shards
        if n == 1:
            tables = self._tables(0)
            got = arrow_map(docs, lambda: _summed(tables, 1, 0), {"text": text_col}, FOUND, keep)
        else:

            def one(s: int):
                def run(texts: DataFrame) -> DataFrame:
                    tables = self._tables(s)
                    return arrow_map(texts, lambda: _summed(tables, n, s), {"text": "text"}, FOUND, ["_text_hash"])

                return run

            strongest = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, TOP).alias("top")
            kept = [c for c in dict.fromkeys(docs.columns if keep is None else keep) if c.lower() not in FOUND.names]
            sums = F.array(*(F.sum(F.col("sums")[i]) for i in range(3))).alias("sums")
            got = in_passes(docs, text_col, kept, (one(s) for s in range(n)), [F.sum("words").alias("words"), sums, strongest])
        means = [F.aggregate(F.slice("top", 1, k), F.lit(0.0), lambda t, x: t + x) / k for k in STRONGEST]
        whole = [F.col("sums")[i] / F.greatest("words", F.lit(1)) for i in (0, 2)]
        return got.withColumn("ratios", F.array(*means, *whole, F.log1p(F.col("sums")[1]), F.log1p("words"))).drop(*FOUND.names)

    def scored(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Rows of ``docs`` (columns ``keep``, default all) with ``ratios`` and ``score``."""
        got = self.ratios(docs, self.text_col, keep)
        if self.weights is None:
            return got.withColumn("score", F.lit(self.only))
        margin = F.lit(float(self.weights[-1]))
        for i in range(len(self.weights) - 1):
            margin = margin + (F.col("ratios")[i] - float(self.centre[i])) / float(self.scale[i]) * float(self.weights[i])
        return got.withColumn("score", 1 / (1 + F.exp(-margin)))
