"""Quality rules by host: rule failures add up by domain, and a domain's shrunk rates judge all its documents.

*Rules.*  A document's counts (words, their code points, symbols, repeated lines, words within repeated windows)
are taken from its whole text; each rule of ``RULES`` says of them whether the document fails.

*Hosts.*  Failures are summed by host, combined before the shuffle.  A host's rate for a rule is shrunk with
a beta prior that the hosts themselves give by the method of moments: mean ``m`` and variance ``v`` of the hosts' rates,
less what chance alone adds to ``v``; the prior counts as ``m (1 - m) / v - 1`` documents (between
``LEAST`` and ``MOST``) of which ``m`` fail.  So a host of one bad page says little and a host of thousands speaks for itself.
A host is rejected if a shrunk rate is above ``limit``, and its verdict is joined back to its documents.

*Scale.*  Only built-in functions run.  Texts are read once and stay where they are; what is written, grouped and joined is
a narrow row a document.  The table of hosts is written, so that Spark broadcasts it only where its files are below
Spark's own threshold; otherwise the join is by sorting, where a host with a third of all rows is split by
Spark's adaptive plan.  One row of sums comes to the driver.

Words are the runs of ``[^\\x20\\x09-\\x0D]``.  Windows are known by 64-bit hashes, compared within one text only
(two of a million windows are alike by chance once in forty million such texts).

Defined cases: null, empty and blank texts have no words and fail; a null host is no host, and its documents are
judged alone; repeated rows count each; an empty table gives no rows; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.llm.shared import pick, written

WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bounds of a prior's weight, in documents.
LEAST, MOST = 2.0, 10_000.0

#: What fails a document by itself.
BASE: Mapping[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 20,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
}
#: What counts against a host: the above, a symbol for each ten words, a third of lines repeated, odd mean word lengths.
RULES = {
    **BASE,
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` made once a row, however often and wherever ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _rest(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.size(items))


def _covered(hashes: Column, width: int) -> Column:
    """Positions within windows whose hash occurs again, from the windows' hashes in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        both = F.zip_with(s, _rest(s), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    def words(p: Column) -> Column:
        steps = F.zip_with(p, _rest(p), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return _let(_let(placed, starts), words)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that the array of words holds twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, width)))
    return F.when(F.size(words) > width, found).otherwise(F.lit(0))


def counts(text: Column) -> Column:
    """A struct of what the rules look at."""

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        repeated = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
        made = {
            "n_words": F.size(words),
            "word_chars": F.length(F.translate(text, SPACE, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": repeated["again"],
            "n_lines": repeated["n"],
            "n_repeat_words": repeat_words(words),
        }
        return F.struct(*(c.cast("long").alias(n) for n, c in made.items()))

    trimmed = F.btrim(text, F.lit(SPACE))
    return _let(F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")), of)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host``, the counts, ``base_failed`` and a boolean for each rule (``failed_<rule>``), a row for each document."""
    rows = pick(docs, {"doc_id": id_col, "host": host_col, "text": text_col})
    made = rows.select("doc_id", "host", counts(F.coalesce("text", F.lit(""))).alias("c")).select("doc_id", "host", "c.*")
    base = F.lit(False)
    for rule in BASE.values():
        base = base | rule()
    return made.withColumn("base_failed", base).withColumns({f"failed_{n}": rule() for n, rule in RULES.items()})


def host_rates(rows: DataFrame) -> DataFrame:
    """``host, n_docs`` and each rule's shrunk rate (``rate_<rule>``), a row for each host, from :func:`counted`."""
    hosts = rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(f"failed_{r}").alias(f"n_{r}") for r in RULES))
    raw = {r: F.col(f"n_{r}") / F.col("n_docs") for r in RULES}
    moments = [m for r in RULES for m in (F.avg(raw[r]).alias(f"m_{r}"), F.var_pop(raw[r]).alias(f"v_{r}"))]
    sums = hosts.agg(F.avg(1 / F.col("n_docs")).alias("chance"), *moments).first()
    rates = []
    for r in RULES:
        mean, spread = sums[f"m_{r}"] or 0.0, (sums[f"v_{r}"] or 0.0)
        own = mean * (1 - mean)
        between = spread - own * (sums["chance"] or 0.0)
        weight = min(MOST, max(LEAST, own / between - 1)) if between > 0 else MOST
        rates.append(((F.col(f"n_{r}") + weight * mean) / (F.col("n_docs") + weight)).alias(f"rate_{r}"))
    return hosts.select("host", "n_docs", *rates)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """The columns of :func:`counted` with ``host_rejected`` and ``kept``."""
    rows = written(counted(docs, id_col, text_col, host_col), "counted")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.col(f"rate_{r}") > limit)
    verdicts = written(host_rates(rows).select(F.col("host").alias("_host"), bad.alias("_bad")).where("_bad"), "hosts")
    joined = rows.join(verdicts, F.col("host") == F.col("_host"), "left")
    rejected = F.coalesce("_bad", F.lit(False))
    return joined.select(*rows.columns, rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))
