"""A training-corpus pipeline over ``documents``: five stages, each written and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but
the last return the columns of ``docs``; the last returns the mix.

Defined cases, by stage: a null or empty text goes in the first; a text without a letter goes in the second; a
blank text would be nobody's copy, a null or wordless one clean and of size 0, where a stage is called alone.
Of repeated rows one stays from the third stage on.  Without labels nothing with a letter goes in the first two;
without a benchmark nothing goes in the fourth.  Empty tables give no rows.  Extra columns are carried through, named
as they may be, up to the mix, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.llm import decontaminate, language, mixing, near_duplicates, quality
from tallyrill.llm.queries import table
from tallyrill.llm.shared import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under trusted text is beyond their language's threshold."""
    return quality.Judge(docs, table(spark, sf_dir, "labels"), carry=True).kept()


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or scored below nearly all that are told rightly in their language."""
    return language.kept(docs)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_duplicates.representatives(docs, width=5, percent=80)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark windows cover by a twentieth or more."""
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    found = decontaminate.scan(plain, table(spark, sf_dir, "benchmark"), f"_c{docs.columns.index('text')}", spans=False)
    return decontaminate.judged(found).where(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs, mixing.cyclic_weights((3, 1, 2)))


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("mixing sources to target weights", source_mix),
]

#: The stages train and sketch; SQL cannot express them. ``tests/llm/test_pipeline.py`` holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
