"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of ``SPAN`` bytes.  Two gated recurrent layers of
``units`` units read each window forwards and backwards, and every position gets a
probability for each language from both states.  A document's probabilities are the means
over its positions that hold a letter (ASCII letters and all bytes from 0x80).  Whole texts
are read: each byte is in exactly one window.

Training is backpropagation through time with Adam, on every window of every labelled document (``fitted``): blocks
of windows are dealt by hash into parts of some megabytes, each part trains its own copy of the network, and the copies' weighted mean
is the network of the next of ``ROUNDS`` rounds.  A document belongs to one round.  Languages weigh alike, but
none more than ``HEAVIEST`` times its share of the text.  Order and parts depend on hashes and on the size of the text, and
means are sums of integers, so files laid out otherwise give the same network.  Only sums of weights come to the driver.
Copies that are averaged must begin close to each other; what they begin with is trained on the driver (``train``) from at most
``docs_per_language`` documents of each language, the first by hash of their ids (and texts, where an id occurs more than once),
and at most ``windows_per_doc`` windows of each, evenly spaced over the whole text.
At most ``max_languages`` languages are learned, those with most rows, so a column of stray
values is no burden; documents of the others are told as the learned one that is most like them.

Defined cases: ``und`` with score 0 where the text is null or has no letter, or where there was
nothing to learn from; rows with a null language or id are not learned from; ties go to the language that
comes first by code point; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.samples import first_by_hash
from tallyrill.llm.shared import arrow_map, mapped, pick, utf8, written

SPAN, ROWS = 64, 4096
#: Rounds over the labelled text, bytes of windows in a part of a round, windows in a block; bytes that are read in a row, and how many such spans, in a step.
ROUNDS, PART, BLOCK, READ, STEP = 4, 2 << 20, 8, 32, 1024
#: Most that a language weighs beyond its share of the text; fractions of a weight in its sums.
HEAVIEST, FRACTION = 8.0, 1 << 24
#: ASCII letters and every byte of a longer UTF-8 sequence.
LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])
ASCII_LETTER = re.compile(rb"[A-Za-z]")


# --- the network --------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
        np.negative(x, out=x)
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


#: Memory that steps of training use again, by name and type.
_ROOM: dict[tuple, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    size = int(np.prod(shape))
    if (name, dtype) not in _ROOM or _ROOM[name, dtype].size < size:
        _ROOM[name, dtype] = np.empty(size, dtype)
    return _ROOM[name, dtype][:size].reshape(shape)


class Network:
    """Weights by name; ``w0, w1``: bytes to gates of either direction, ``u0, u1``: states to gates, ``o0, o1, b``: states to languages.

    Gates are update, reset and candidate, ``units`` rows each; columns are windows.
    """

    def __init__(self, languages: int, units: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.units = units
        self.weights = {"b": np.zeros((languages, 1), np.float32)}
        for d in "01":
            self.weights["w" + d] = (rng.standard_normal((3 * units, 256)) * 0.3).astype(np.float32)
            self.weights["u" + d] = (rng.standard_normal((3 * units, units)) / np.sqrt(units)).astype(np.float32)
            self.weights["o" + d] = (rng.standard_normal((languages, units)) / np.sqrt(units)).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """``x``: bytes (positions, windows); logits (positions, languages, windows)."""
        k, (steps, columns) = self.units, x.shape
        out = np.empty((steps, len(self.weights["b"]), columns), np.float32)
        out[:] = self.weights["b"]
        gates, inner = np.empty((3 * k, columns), np.float32), np.empty((3 * k, columns), np.float32)
        for d in "01":
            w, u, o = (self.weights[n + d] for n in "wuo")
            h = np.zeros((k, columns), np.float32)
            for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
                np.take(w, x[t], axis=1, out=gates, mode="clip")
                np.matmul(u, h, out=inner)
                gates[: 2 * k] += inner[: 2 * k]
                _sigmoid(gates[: 2 * k])
                n = gates[2 * k :]
                n += np.multiply(inner[2 * k :], gates[k : 2 * k], out=inner[2 * k :])
                _tanh(n)
                h -= n
                h *= gates[:k]
                h += n
                out[t] += o @ h
        return out

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, ...]:
        """Update and reset gates, candidates, their inner parts and states, as (positions, units, windows); ``states[t]`` precedes ``states[t + 1]``
        in the order of reading."""
        k, (steps, columns) = self.units, x.shape
        w, u = self.weights["w" + d], self.weights["u" + d]
        of, inners, states = (_room(n + d, shape, w.dtype) for n, shape in (("of", (steps, 3 * k, columns)), ("inners", (steps, k, columns)), ("states", (steps + 1, k, columns))))
        inner = _room("inner", (3 * k, columns), w.dtype)
        states[0] = 0
        for i, t in enumerate(range(steps) if d == "0" else range(steps - 1, -1, -1)):
            gates, h = of[i], states[i + 1]
            np.take(w, x[t], axis=1, out=gates, mode="clip")
            np.matmul(u, states[i], out=inner)
            gates[: 2 * k] += inner[: 2 * k]
            _sigmoid(gates[: 2 * k])
            n = gates[2 * k :]
            inners[i] = inner[2 * k :]
            n += np.multiply(inners[i], gates[k : 2 * k], out=inner[2 * k :])
            _tanh(n)
            np.subtract(states[i], n, out=h)
            h *= gates[:k]
            h += n
        return of, inners, states

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the masked positions, and its gradients; ``y``: a language for each window."""
        k, g = self.units, {n: np.zeros_like(v) for n, v in self.weights.items()}
        steps, columns = x.shape
        runs = {d: self._run(x, d) for d in "01"}
        states = {"0": runs["0"][2][1:], "1": runs["1"][2][:0:-1]}
        kind, languages = self.weights["b"].dtype, len(self.weights["b"])
        z = np.matmul(self.weights["o0"], states["0"], out=_room("z", (steps, languages, columns), kind))
        z += self.weights["b"]
        z += np.matmul(self.weights["o1"], states["1"], out=_room("z1", z.shape, kind))
        z -= z.max(1, keepdims=True)
        p = np.exp(z, out=z)
        p /= p.sum(1, keepdims=True)
        at = np.arange(columns)
        share = mask / mask.sum()
        loss = -float((np.log(p[:, y, at] + 1e-9) * share).sum())
        dz = p
        dz[:, y, at] -= 1
        dz *= share[:, None, :]
        g["b"] += dz.sum((0, 2))[:, None]
        for d in "01":
            u, (of, inners, before) = self.weights["u" + d], runs[d]
            g["o" + d] += np.matmul(dz, states[d].transpose(0, 2, 1)).sum(0)
            back = np.matmul(self.weights["o" + d].T, dz, out=_room("back", (steps, k, columns), kind))
            into, state = _room("into", (3 * k, steps, columns), kind), _room("state", (3 * k, columns), kind)
            dh, keep, one = (_room(n, (k, columns), kind) for n in ("dh", "keep", "one"))
            dzt, dr, inner = state[:k], state[k : 2 * k], state[2 * k :]
            dh[:] = 0
            for i in range(steps - 1, -1, -1):
                t = i if d == "0" else steps - 1 - i
                zt, r, n = of[i, :k], of[i, k : 2 * k], of[i, 2 * k :]
                dh += back[t]
                np.multiply(dh, zt, out=keep)
                dh -= keep
                np.multiply(n, n, out=one)
                np.subtract(1, one, out=one)
                np.multiply(dh, one, out=one)
                into[2 * k :, t] = one
                np.multiply(one, r, out=inner)
                np.multiply(inner, inners[i], out=dr)
                np.subtract(1, of[i, : 2 * k], out=of[i, : 2 * k])
                dr *= r
                np.subtract(before[i], n, out=dzt)
                dzt *= keep
                dzt *= zt
                into[: 2 * k, t] = state[: 2 * k]
                g["u" + d] += state @ before[i].T
                np.matmul(u.T, state, out=dh)
                dh += keep
            read = x.ravel()
            g["w" + d] += [np.bincount(read, row, 256) for row in into.reshape(3 * k, -1)]
        return loss, g


class Adam:
    """Steps against a network's gradients, of a norm of 1 at most."""

    def __init__(self, net: Network) -> None:
        self.net, self.steps = net, 0
        self.m, self.v = ({n: np.zeros_like(w) for n, w in net.weights.items()} for _ in range(2))

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, rate: float) -> None:
        self.steps += 1
        m, v = self.m, self.v
        _, g = self.net.gradients(x, y, mask)
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((a * a).sum()) for a in g.values())) + 1e-9))
        for n, a in g.items():
            a = a * scale
            m[n] = 0.9 * m[n] + 0.1 * a
            v[n] = 0.99 * v[n] + 0.01 * a * a
            self.net.weights[n] -= (rate * (m[n] / (1 - 0.9**self.steps)) / (np.sqrt(v[n] / (1 - 0.99**self.steps)) + 1e-7)).astype(np.float32)


def _mask(x: np.ndarray) -> np.ndarray:
    return LETTER[x].astype(np.float32) + np.float32(1e-3)


def train(windows: np.ndarray, labels: np.ndarray, languages: int, units: int = 8, steps: int = 400, batch: int = 128, span: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    """``windows``: bytes (windows, SPAN). Languages are drawn evenly; each step sees spans of ``span`` bytes."""
    net, rng = Network(languages, units, seed), np.random.default_rng(seed)
    by = [np.flatnonzero(labels == c) for c in range(languages)]
    adam = Adam(net)
    for step in range(1, steps + 1):
        y = rng.integers(0, languages, batch)
        rows = np.array([by[c][rng.integers(len(by[c]))] for c in y])
        at = rng.integers(0, windows.shape[1] - span + 1)
        x = np.ascontiguousarray(windows[rows, at : at + span].T)
        adam.step(x, y, _mask(x), rate * min(1.0, 2 * (1 - step / (steps + 1))))
    return net


# --- documents ----------------------------------------------------------------------------


def cut(text: bytes, most: int | None = None) -> np.ndarray:
    """Windows of a text as rows, padded with spaces; at most ``most``, evenly spaced."""
    rows = np.frombuffer(text + b" " * (-len(text) % SPAN), np.uint8).reshape(-1, SPAN)
    return rows if most is None or len(rows) <= most else rows[np.linspace(0, len(rows) - 1, most).astype(int)]


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def _known(docs: DataFrame, text_col: str, lang_col: str, id_col: str, max_languages: int) -> DataFrame:
    """``_lang, _h, _t, text``: what may be learned from, with hashes of ids and texts, of the ``max_languages`` languages with most rows (ties by code point)."""
    often = pick(docs, {"_lang": lang_col}).where("_lang is not null").groupBy("_lang").count()
    often = [r[0] for r in often.orderBy(F.desc("count"), "_lang").limit(max_languages).collect()]
    place = F.xxhash64(F.col("_id").cast("string")), F.xxhash64("text")
    plain = pick(docs, {"_lang": lang_col, "_id": id_col, "text": text_col}).where("_lang is not null and _id is not null and text is not null").where(F.col("_lang").isin(often))
    return plain.where(F.col("text").rlike(r"\p{L}")).select("_lang", place[0].alias("_h"), place[1].alias("_t"), "text")


def sampled_windows(docs: DataFrame, learn: Column, text_col: str, lang_col: str, id_col: str, docs_per_language: int, windows_per_doc: int, max_languages: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by code point, and the windows of the first documents of each by hash, with their language numbers."""
    plain = _known(docs.where(learn), text_col, lang_col, id_col, max_languages)
    return _first_windows(plain, docs_per_language, windows_per_doc)


def _first_windows(plain: DataFrame, docs_per_language: int, windows_per_doc: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    first = first_by_hash(plain.select("_lang", "_h", "_t"), "_lang", docs_per_language, ("_h", "_t"))
    texts = plain.join(F.broadcast(first), ["_lang", "_h", "_t"]).groupBy("_lang", "_h", "_t").agg(F.first("text").alias("text")).select("_lang", "text")

    def run(batches):
        for batch in batches:
            rows = [(lang, w.tobytes()) for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) if text and has_letter(text) for w in cut(text, windows_per_doc)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "w"])

    got = mapped(texts, run, "lang string, w binary").toArrow()
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("w").to_pylist(), strict=True))
    names = sorted({p[0] for p in pairs})
    number = {n: i for i, n in enumerate(names)}
    return names, np.frombuffer(b"".join(p[1] for p in pairs), np.uint8).reshape(-1, SPAN), np.array([number[p[0]] for p in pairs], int)


def _blocks(plain: DataFrame, names: list[str]) -> DataFrame:
    """``key, lang, w``: all windows of all texts, ``BLOCK`` at a time, by a hash of document and place; ``lang``: its number."""
    number, size = {n: i for i, n in enumerate(names)}, BLOCK * SPAN

    def run(batches):
        for batch in batches:
            parts, counts, langs = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(3)), strict=True):
                raw = cut(text).tobytes() if lang in number and has_letter(text) else b""
                counts.append(-(-len(raw) // size))
                langs.append(number.get(lang, -1))
                parts += [raw[at : at + size] for at in range(0, len(raw), size)]
            same = [np.repeat(c.to_numpy(), counts) for c in batch.columns[1:3]]
            j = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(j), pa.array(np.repeat(langs, counts), pa.int32()), pa.array(parts, pa.binary())], names=["_h", "_t", "j", "lang", "w"])

    got = mapped(plain, run, "_h long, _t long, j long, lang int, w binary")
    return got.select(F.xxhash64("_h", "_t", "j").alias("key"), "lang", "w")


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in sorted(weights)])


def _trained(net: Network, weigh: np.ndarray, rate):
    """Trains a copy of ``net`` on the blocks of a part, as they come; ``rate``: of a step, by its number. Rows: a weight's number
    and the weight, as an integer, times the steps; and behind the last weight the steps."""

    def run(batches):
        own = copy.deepcopy(net)
        adam, langs, spans = Adam(own), [], []

        def step(y, rows):
            x = np.ascontiguousarray(rows.T)
            adam.step(x, y, _mask(x) * weigh[y], rate(adam.steps) * len(y) / STEP)

        def steps(least):
            y, rows = np.concatenate(langs), np.concatenate(spans)
            at = 0
            while len(y) - at >= least:
                step(y[at : at + STEP], rows[at : at + STEP])
                at += STEP
            return [y[at:]], [rows[at:]]

        for batch in batches:
            for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans.append(np.frombuffer(w, np.uint8).reshape(-1, READ))
                langs.append(np.full(len(spans[-1]), lang))
                if len(spans) * BLOCK * SPAN // READ >= STEP:
                    langs, spans = steps(STEP)
        if spans:
            steps(1)
        if adam.steps:
            sums = np.rint(_flat(own.weights).astype(float) * FRACTION).astype(np.int64) * adam.steps
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums) + 1, dtype=np.int32)), pa.array(np.append(sums, adam.steps))], names=["i", "n"])

    return run


def fitted(net: Network, names: list[str], plain: DataFrame, rate: float = 0.005) -> Network:
    """``net`` after training on every window of ``plain`` (``_lang, _h, _t, text``), in parts whose networks are averaged every round."""
    sizes = {r[0]: r[1] for r in plain.groupBy("_lang").agg(F.sum(F.octet_length("text"))).collect()}
    total = sum(sizes.values())
    weigh = np.array([min(HEAVIEST, total / (len(names) * max(1, sizes.get(n, 0)))) for n in names], np.float32)
    parts = max(1, -(-total // (ROUNDS * PART)))
    steps = max(1.0, total / (ROUNDS * parts * READ * STEP))
    for turn in range(ROUNDS):
        mine = plain.where(F.pmod(F.xxhash64(F.lit("round"), "_h", "_t"), F.lit(ROUNDS)) == turn)
        dealt = _blocks(mine, names).repartition(parts, "key").sortWithinPartitions("key").select("lang", "w")
        falling = lambda step, turn=turn: rate * max(0.05, 1 - (turn + min(1.0, step / steps)) / ROUNDS)
        got = mapped(dealt, _trained(net, weigh, falling), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        if not len(got):
            continue
        sums = got.column("n").to_numpy()[np.argsort(got.column("i").to_numpy())]
        mean, at, net = sums[:-1] / (float(sums[-1]) * FRACTION), 0, copy.deepcopy(net)
        for n in sorted(net.weights):
            w = net.weights[n]
            net.weights[n] = mean[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
    return net


GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def pooled(net: Network, texts: list[bytes | None], languages: int) -> np.ndarray:
    """Mean probabilities of each text's letter positions (0 for texts without letters)."""
    parts = [cut(t) if t and has_letter(t) else np.zeros((0, SPAN), np.uint8) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    rows = np.concatenate(parts) if parts else np.zeros((0, SPAN), np.uint8)
    total, count = np.zeros((len(texts), languages)), np.zeros(len(texts))
    for at in range(0, len(rows), ROWS):
        x = np.ascontiguousarray(rows[at : at + ROWS].T)
        z = net.logits(x)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        mask = LETTER[x]
        z *= (mask / z.sum(1))[:, None, :]
        who = owner[at : at + ROWS]
        each = z.sum(0)
        for c in range(languages):
            total[:, c] += np.bincount(who, each[c], len(texts))
        count += np.bincount(who, mask.sum(0), len(texts))
    return total / np.maximum(count, 1)[:, None]


class Identifier:
    """A trained identifier; ``labelled`` applies it."""

    def __init__(self, docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400, windows_per_doc: int = 12, units: int = 8, steps: int = 400, max_languages: int = 256) -> None:
        """``learn``: a condition over the columns of ``docs`` that training rows fulfil."""
        self.text_col = text_col
        plain = _known(docs if learn is None else docs.where(learn), text_col, lang_col, id_col, max_languages)
        self.names, windows, labels = _first_windows(plain, docs_per_language, windows_per_doc)
        self.net = fitted(train(windows, labels, len(self.names), units, steps), self.names, plain) if self.names else None

    def labelled(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Rows of ``docs`` with ``lang_pred`` and ``score``, the pooled probability of that language."""
        shared = docs.sparkSession.sparkContext.broadcast((self.names, self.net))
        return arrow_map(docs, lambda: _guesses(shared), {"text": self.text_col}, GUESS, keep)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.0005, least: int = 50) -> DataFrame:
    """The rows of ``docs`` whose language is told surely enough.

    The network learns from one half of the labelled ids.  In the other half, the documents of each language that are
    told rightly set its bound: the ``quantile`` of their scores (of all languages together, where a
    language has fewer than ``least``).  Below it, and without a letter, a document goes.  Without labels all with a
    letter stay, as there is nothing to tell them by.
    """
    names = docs.columns
    at = {c: f"_c{names.index(c)}" for c in (id_col, text_col, lang_col)}
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    fold = F.pmod(F.xxhash64(F.lit("language"), F.col(at[id_col]).cast("string")), F.lit(2))
    found = Identifier(plain, fold == 0, at[id_col], at[text_col], at[lang_col])
    if not found.names:
        return plain.where(F.coalesce(F.col(at[text_col]).rlike(r"\p{L}"), F.lit(False))).toDF(*names)
    scored = written(found.labelled(plain), "languages")
    right = scored.where((fold == 1) & (F.col("lang_pred") == F.col(at[lang_col])))
    low = F.percentile_approx("score", quantile, 100_000)
    by = written(right.groupBy(F.col("lang_pred").alias("_by")).agg(low.alias("_bound"), F.count("*").alias("_n")).where(F.col("_n") >= least), "bounds")
    overall = right.agg(low).first()[0] or 0.0
    sure = scored.join(by, F.col("lang_pred") == F.col("_by"), "left").where((F.col("lang_pred") != "und") & (F.col("score") >= F.coalesce("_bound", F.lit(overall))))
    return sure.select(*plain.columns).toDF(*names)


def _guesses(shared):
    names, net = shared.value

    def step(batch: pa.RecordBatch):
        guess, score = [], []
        texts = utf8(batch.column("text"))
        at = 0
        while at < len(texts):  # groups of about 4 MB
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1 << 22):
                size += len(texts[end] or b"")
                end += 1
            part = texts[at:end]
            p = pooled(net, part, len(names)) if net else np.zeros((len(part), 1))
            best = p.argmax(1)
            for i, row in zip(best.tolist(), p, strict=True):
                known = row[i] > 0
                guess.append(names[i] if known else "und")
                score.append(min(1.0, float(row[i])) if known else 0.0)
            at = end
        return {"lang_pred": pa.array(guess, pa.string()), "score": pa.array(score, pa.float64())}, None

    return step
