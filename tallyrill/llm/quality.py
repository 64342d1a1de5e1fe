"""Quality by perplexity under a Kneser-Ney model of trusted text.

The model (see ``ngram``: interpolated, modified, characters, order 5, counts joined in shards)
is fitted on all trusted documents of one half of the ids; their ids are broadcast where they are at most ``TRUSTED``, else
joined by sorting, and a model beyond one shard is looked up a shard at a time.  Every document of the corpus is then read once more and gets its perplexity per character.
All trusted documents of the other half, which the model has not seen, set the thresholds: in each
language the ``quantile`` of their mean losses.  A language with fewer than ``least`` of
them gets the threshold of all languages together.  Thresholds are a table, joined by language.

Short texts carry little evidence: what is held against a threshold is a text's mean loss as if
``evidence`` more characters of the trusted mean loss had been read (``weighed``, a perplexity), so
that a short clean sentence is not rejected for one odd name.  ``perplexity`` is the document's own.

Defined cases: null or empty texts have no perplexity (null) and are rejected; a null
language is a language of its own; without trusted text or trusted quantiles (empty
tables) nothing with a character of text is rejected; repeated rows are judged alike, and counted each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.llm import ngram
from tallyrill.llm.shared import discard, pick, written

#: Most ids of trusted documents that are broadcast.
TRUSTED = 2_000_000


class Judge:
    """A fitted model with its thresholds; ``scored`` and ``kept`` apply it to the corpus ``docs``.

    The corpus is scored once, when the thresholds are set: its losses stay in a written table, with
    all columns of ``docs`` where ``carry`` says so (then ``kept`` is a filter of that table).  Other
    documents may be given to ``scored`` and ``kept``; those are scored then.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", trusted: int = 1, quantile: float = 0.9995, least: int = 50, evidence: int = 100, carry: bool = False) -> None:
        self.id_col, self.text_col, self.lang_col, self.evidence = id_col, text_col, lang_col, evidence
        self.docs, self.carry = docs, carry
        fold = F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(2))
        known = pick(labels, {"_id": id_col, "_label": label_col}).where((F.col("_label") == trusted) & F.col("_id").isNotNull())
        fitted = known.where(fold == 0).select("_id").distinct()
        fitted = F.broadcast(fitted) if fitted.count() <= TRUSTED else fitted.hint("merge")
        texts = pick(docs, {"_d": id_col, "text": text_col})
        trusted_texts = written(texts.join(fitted, F.col("_d") == F.col("_id"), "left_semi").select("text"), "trusted")
        self.letters = ngram.alphabet(trusted_texts)
        self.model = ngram.model(ngram.count_ngrams(trusted_texts, self.letters), bits=self.letters.bits)
        discard(trusted_texts)
        self.losses = written(self._losses(docs, carry), "losses")
        others = known.where(fold == 1).select("_id").distinct()
        believed = self.losses.join(others, F.col("_d") == F.col("_id"), "left_semi").where("n_tokens > 0")
        self.mean_loss = believed.agg(F.sum("loss") / F.sum("n_tokens")).first()[0] or 0.0
        high = F.percentile_approx(self._weighed(), quantile, 100_000)
        by_lang = believed.groupBy("_l").agg(high.alias("limit"), F.count("*").alias("n")).where(F.col("n") >= least)
        self.limits = written(by_lang.select(F.col("_l").alias("_by"), "limit"), "limits")
        overall = believed.agg(high.alias("limit")).first()["limit"]
        self.default = float("inf") if overall is None else float(overall)

    def _weighed(self):
        return (F.col("loss") + F.lit(self.evidence * self.mean_loss)) / (F.col("n_tokens") + self.evidence)

    def _losses(self, docs: DataFrame, carry: bool) -> DataFrame:
        """``_d, _l, n_tokens, loss`` and, if ``carry``, the columns of ``docs`` as ``_c0, _c1, ...``."""
        wanted = {"_d": self.id_col, "_l": self.lang_col, "_t": self.text_col}
        rows = pick(docs, wanted | ({f"_c{i}": c for i, c in enumerate(docs.columns) if c != self.text_col} if carry else {}))
        keep = [c for c in rows.columns if c != "_t" or carry]
        got = ngram.log_likelihoods(rows, [self.model], self.letters, "_t", keep)
        return got.withColumn("loss", -F.col("log_likelihood")[0]).drop("log_likelihood")

    def _judged(self, docs: DataFrame | None, carry: bool) -> DataFrame:
        own = docs is None or docs is self.docs
        losses = self.losses if own and (self.carry or not carry) else self._losses(self.docs if own else docs, carry)
        limited = losses.join(self.limits, F.col("_l").eqNullSafe(F.col("_by")), "left").withColumn("_limit", F.coalesce("limit", F.lit(self.default)))
        keep = (F.col("n_tokens") > 0) & (self._weighed() <= F.col("_limit"))
        return limited.withColumn("keep", F.coalesce(keep, F.lit(False)))

    def scored(self, docs: DataFrame | None = None) -> DataFrame:
        """``doc_id, lang, n_tokens, perplexity, weighed, threshold, keep`` for every row of ``docs`` (default: the corpus)."""
        some = F.col("n_tokens") > 0
        own = F.when(some, F.exp(F.col("loss") / F.col("n_tokens"))).alias("perplexity")
        weighed = F.when(some, F.exp(self._weighed())).alias("weighed")
        return self._judged(docs, False).select(F.col("_d").alias("doc_id"), F.col("_l").alias("lang"), "n_tokens", own, weighed, F.exp("_limit").alias("threshold"), "keep")

    def kept(self, docs: DataFrame | None = None) -> DataFrame:
        """The rows of ``docs`` (default: the corpus) that are not rejected, with the columns of ``docs``."""
        names = (self.docs if docs is None else docs).columns
        got = self._judged(docs, True).where("keep")
        return got.select(*(F.col("_t" if c == self.text_col else f"_c{i}").alias(c) for i, c in enumerate(names)))
