"""URL rules by a sort-merge range join over reversed-host keys.

A host's canonical key is its labels in reverse, each followed by a dot: ``blog.example.org``
becomes ``org.example.blog.``.  A rule host and all its subdomains are then the keys with
the rule's key as prefix, one interval of the sorted keys, and the intervals are nested or
disjoint.  Each task sorts its own URLs by key and sweeps them once beside the sorted rules;
a stack holds the rules whose intervals contain the current key, outermost first.  No URL
moves between tasks, so a host with a third of all URLs costs nothing extra.

The rules are measured first.  Up to ``max_shard_bytes`` they are broadcast; beyond, they
are dealt by host into shards within the bound, and the URLs are judged once a shard, with one
shard alive at a time; of the shards' rules for a URL the longest is taken in the end.

Defined cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end; both are empty for a null
URL or one without ``://``.  A rule fits when the path starts with the rule's path, taken
literally (so ``/`` does not fit an empty path).  The longest rule (host and path together)
wins, on a tie the one with the longer host; where a rule is listed as allow and as block,
block wins.  Rules with a null or empty host are ignored; a null rule path is empty.  Where
no rule fits, ``rule`` is null and ``verdict`` is ``default`` (allow).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.shared import arrow_map, in_passes, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEST = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("_length", T.IntegerType()), T.StructField("_host_length", T.IntegerType())])


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def _sweep(groups: list[tuple[str, int, dict[str, tuple[str, str]]]]):
    """``groups``: (key, host length, {path: (rule, verdict)}) sorted by key."""
    lengths = [sorted({len(p) for p in g[2]}, reverse=True) for g in groups]
    stack: list[int] = []
    at = 0
    last: tuple[str, str] | None = None
    best: tuple[str | None, str | None, int, int] = (None, None, -1, -1)

    def judge(key: str, path: str):
        nonlocal at, last, best
        if last is not None and key < last[0]:  # a new sorted run begins
            stack.clear()
            at = 0
        if (key, path) == last:
            return best
        last, best = (key, path), (None, None, -1, -1)
        while stack and not key.startswith(groups[stack[-1]][0]):
            stack.pop()
        while at < len(groups) and groups[at][0] <= key:
            if key.startswith(groups[at][0]):
                stack.append(at)
            at += 1
        for g in stack:
            _, n, by_path = groups[g]
            for length in lengths[g]:
                if length <= len(path) and (hit := by_path.get(path[:length])):
                    best = max(best, (*hit, n + length, n), key=lambda x: x[2:])
                    break
        return best

    return judge


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: list[str] | None = None, default: str = "allow", max_shard_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has the columns ``host``, ``path`` and ``verdict`` (allow or block).
    """
    spark = pages.sparkSession
    own = [c for c in (pages.columns if keep is None else keep) if c.lower() not in {"host", "path", "rule", "verdict"}]
    parsed = pick(pages, {"_url": url_col} | {f"_k{i}": c for i, c in enumerate(own)})
    names = [f"_k{i}" for i in range(len(own))]
    tidy = pick(rules, {"host": "host", "path": "path", "verdict": "verdict"}).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != '' and verdict is not null")
    tidy = tidy.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    total = tidy.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    shards = max(1, -(-total // max_shard_bytes))

    def judged(urls: DataFrame, url: str, keep: list[str], shard: int) -> DataFrame:
        """``host, path`` and the best of a shard's rules for each URL."""
        groups: dict[str, tuple[str, int, dict]] = {}
        for r in tidy.where(F.pmod(F.xxhash64("host"), F.lit(shards)) == shard).collect():
            groups.setdefault(r["key"], (r["key"], len(r["host"]), {}))[2][r["path"]] = (r["host"] + r["path"], r["verdict"])
        shared = spark.sparkContext.broadcast([groups[key] for key in sorted(groups)])
        host, path = host_and_path(F.col(url))
        keyed = urls.select(*keep, host.alias("host"), path.alias("path"), host_key(host).alias("_key")).sortWithinPartitions("_key", "path")
        return arrow_map(keyed, lambda: _judge_batches(shared.value), {"key": "_key", "path": "path"}, BEST, [*keep, "host", "path"])

    if shards == 1:
        out = judged(parsed, "_url", names, 0)
    else:
        passes = (lambda texts, s=s: judged(texts, "text", ["_text_hash"], s) for s in range(shards))
        best = F.max_by(F.struct("rule", "verdict"), F.struct("_length", "_host_length")).alias("_best")
        out = in_passes(parsed, "_url", names, passes, [F.first("host").alias("host"), F.first("path").alias("path"), best])
        out = out.select(*names, "host", "path", "_best.rule", "_best.verdict")
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(own)]
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _judge_batches(groups):
    judge = _sweep(groups)

    def step(batch: pa.RecordBatch):
        rows = [judge(k, p) for k, p in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        return {n: pa.array([r[i] for r in rows], pa.string() if i < 2 else pa.int32()) for i, n in enumerate(BEST.names)}, None

    return step
