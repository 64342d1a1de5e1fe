"""Helpers shared by the corpus operators: column picking, Arrow maps, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.scratch import CLEANUP, clear, discard, shared_dir, written  # noqa: F401  what the operators write


def pick(df: DataFrame, columns: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Select ``{new name: column}`` and ``keep`` by exact name and by position.

    Names that differ only in case, or that occur twice, do not clash; of two
    columns with the same name the first is meant.
    """
    names = df.columns
    for c in [*columns.values(), *keep]:
        if c not in names:
            raise ValueError(f"no column {c!r} among {names}")
    renamed = df.toDF(*(f"_p{i}" for i in range(len(names))))
    out = [F.col(f"_p{names.index(c)}").alias(new) for new, c in columns.items()]
    return renamed.select(*out, *(F.col(f"_p{names.index(c)}").alias(c) for c in keep))


#: Bytes of an Arrow batch on its way to a Python worker; a batch holds one row at least.
BATCH = 8 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, batch: int = BATCH) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes, so that long texts do not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch))
    return df.mapInArrow(run, schema)


def arrow_map(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], tuple[dict[str, pa.Array], pa.Array | None]]],
    inputs: Mapping[str, str],
    result: T.StructType,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append the columns of ``result``, made from the columns ``inputs``, to the rows of ``df``.

    ``make`` is called once a task; what it returns turns a batch with the columns
    ``inputs`` into arrays by name, and a mask of rows to keep or None.
    ``keep`` (default: all) names the columns carried through; one whose name,
    case aside, is that of a result column gives way to it.
    """
    taken = {n.lower() for n in result.names}
    kept = [c for c in dict.fromkeys(df.columns if keep is None else keep) if c.lower() not in taken]
    source = {c: df.schema.fields[df.columns.index(c)] for c in kept}
    schema = T.StructType([T.StructField(c, source[c].dataType, True) for c in kept] + result.fields)
    unique = {f"_i_{n}": c for n, c in inputs.items()}
    plain = pick(df, unique | {f"_k_{i}": c for i, c in enumerate(kept)})
    names = [*kept, *result.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            arrays = batch.columns
            made, mask = step(pa.RecordBatch.from_arrays(arrays[: len(inputs)], names=list(inputs)))
            out = pa.RecordBatch.from_arrays([*arrays[len(inputs) :], *(made[n] for n in result.names)], names=[f"c{i}" for i in range(len(names))])
            yield out if mask is None else out.filter(mask)

    flat = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)])
    return mapped(plain, run, flat).toDF(*names)


def in_passes(docs: DataFrame, text_col: str, keep: Sequence[str], passes: Iterable[Callable[[DataFrame], DataFrame]], total: Sequence[Column]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the aggregates ``total`` over what several passes say of each text.

    A pass turns ``_text_hash, text`` into rows of ``_text_hash`` and columns of its own; it is written, once a
    distinct text, before the next begins, so whatever it broadcasts lives alone.
    """
    named = pick(docs, {"text": text_col} | {f"_k{i}": c for i, c in enumerate(keep)}).withColumn("_text_hash", F.xxhash64("text"))
    parts = []
    for run in passes:
        found = run(named.select("_text_hash", "text"))
        firsts = [F.first(c).alias(c) for c in found.columns if c != "_text_hash"]
        parts.append(written(found.groupBy("_text_hash").agg(*firsts), "pass"))
    joined = named.drop("text").join(reduce(DataFrame.union, parts).groupBy("_text_hash").agg(*total), "_text_hash")
    return joined.drop("_text_hash").withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
