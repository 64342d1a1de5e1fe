"""N-gram Jaccard join by parity sketches.

Two documents link when the Jaccard similarity of their shingle sets is at least
``percent / 100``.  Let ``n`` and ``m`` be two sizes; a link means a symmetric difference of at most
``(n + m) * (100 - percent) / (100 + percent)`` shingles.

*Sketches.*  Shingles are dealt by hash to the blocks of a size band, and each block keeps the
exclusive or of its shingles' hashes: a parity sketch.  A shingle in one set only changes
one block, so the number of differing blocks is a lower bound of the symmetric difference.
A band ``j`` holds sizes from ``4**j`` to below ``4**(j+1)``; sizes just below it that can still link
into it take part too.  It has more blocks than any link in it may have differences.

*Pigeonhole.*  If a set of size ``n`` differs from any possible partner in at most ``d`` shingles, then of
any ``d + 1`` of its blocks one agrees.  Each set emits its ``d + 1`` blocks that come first in one
global order (most shingles first, then by hash), as in prefix filtering: of two linked sets,
the one whose emitted blocks reach less far has an agreeing block among them, and the other
emits that block too.  So every linked pair shares a key, and keys of many shingles, which
few unrelated documents share, carry the join.

*Verification.*  Documents with equal sets form a class, and only classes are joined.  In the sorted
keys each key's classes are paired with its smallest class, in a stream that holds one
row.  Then links are verified from likely to unlikely, and what is already connected is not
compared: first each class with the partner that shares most keys; then the other pairs that
are still apart; last, in keys whose classes are still apart, the pairs of distinct
components, in blocks of at most ``CHUNK`` classes.  In that last part each class first brings its
nearest few of other components, so that components grow as in a minimum spanning tree, and only
then all that are still apart; where all pairs are few (``_few``) they are verified at once.  Components need
no more links than that.  Before shingle sets
are sent anywhere, a bound on the one-bit parity sketches (whose Hamming distance is a lower
bound, too) removes nearly all pairs that do not link; exact verification intersects the sets.

Joins are by sorting (``_merge``): none brings a table through the driver, whose memory each small join
would otherwise take for a while.

Class ids, like shingles, are 64-bit hashes; that two of ``N`` sets collide has the odds
``N**2 / 2**65``.

Defined cases: a null, empty or blank text has no shingles, links with nothing and is its own
component; fewer words than ``width`` count as one shingle; repeated rows have equal sets and
link; a null id never names a component of others (it is null where all ids are); an empty
table gives no rows.  Extra columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm.components import components
from tallyrill.llm.shared import discard, mapped, pick, utf8, written
from tallyrill.llm.shingles import identity, mixed, shingle_sets

SKETCH_BITS, FILTER_BITS, CHUNK = 2048, 1 << 24, 1024
#: Most comparisons a member for which all pairs that are left are listed at once.
LISTED = 32


def difference(n: int, m: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of these sizes."""
    return (n + m) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """The bands of a size: (number, blocks, most differences from a partner in it)."""
    own = (n.bit_length() - 1) // 2
    out = []
    for j in (own, own + 1):
        top = 4 ** (j + 1)
        if j == own or n * 100 >= percent * 4**j:
            most = min(n * 100 // percent, top - 1)
            blocks = difference(top, top, percent) + top // 100 + 2
            out.append((j, blocks, difference(n, most, percent)))
    return out


def block_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """The emitted keys of a set, over all its bands."""
    high, whole = found >> np.uint64(32), mixed(found)
    out = []
    for j, blocks, most in bands(len(found), percent):
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        count = np.diff(np.append(start, len(found)))
        parity, place = np.bitwise_xor.reduceat(whole, start), block[start]
        if most + 1 > len(start):  # then blocks without shingles count, too
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), place)
            parity, place, count = np.append(parity, np.zeros(len(empty), np.uint64)), np.append(place, empty), np.append(count, np.zeros(len(empty), int))
        key = mixed(parity ^ mixed((np.uint64(j) << np.uint64(40)) + place + np.uint64(1)))
        order = np.lexsort((key, -count))[: most + 1]
        out.append(key[order])
    return np.concatenate(out)


def parity_bits(found: np.ndarray) -> np.ndarray:
    """One bit a shingle, exclusive or, as ``SKETCH_BITS / 64`` longs."""
    bits = np.bincount((found & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


class _Recent:
    """Which values this task has seen lately; bounded, so it may forget."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.seen: set[int] = set()
        self.most = most

    def new(self, value: int) -> bool:
        if value in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(value)
        return True


def _sizes(rows: DataFrame, width: int) -> DataFrame:
    """``doc_id, h, n, c`` for every row: hash of the row, size of the set, class (null if empty)."""

    def run(batches):
        for batch in batches:
            n, c = [], []
            for _, found in shingle_sets(utf8(batch.column(2)), width):
                n.append(len(found))
                c.append(identity(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "h", "n", "c"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows.select("doc_id", "h", "text"), run, f"doc_id {kind}, h long, n long, c long")


def _keys(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``key, c``: the emitted blocks of every class (more than once where several tasks meet it)."""

    def run(batches):
        recent = _Recent()
        for batch in batches:
            keys, classes = [], []
            for _, found in shingle_sets(utf8(batch.column(0)), width):
                if len(found) and recent.new(c := identity(found)):
                    keys.append(block_keys(found, percent))
                    classes.append(np.full(len(keys[-1]), c))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes))], names=["key", "c"])

    return mapped(rows.select("text"), run, "key long, c long")


def _stars(keys: DataFrame) -> DataFrame:
    """``key, a, x``: in each key with several classes, each other class ``x`` with the smallest, ``a``."""

    def run(batches):
        key, first, last = None, None, None
        for batch in batches:
            k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
            start = np.where(new, np.arange(len(k)), -1)
            start = np.maximum.accumulate(start)
            least = np.where(start >= 0, c[start], first if first is not None else 0)
            same = np.concatenate([[not new[0] and c[0] == last], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])
            out = (c != least) & ~same
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (k, least, c)], names=["key", "a", "x"])
            key, first, last = k[-1], least[-1], c[-1]

    return mapped(keys.repartition("key").sortWithinPartitions("key", "c"), run, "key long, a long, x long")


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits over row hashes: 2 MB, however many rows there are."""
    at = F.pmod("h", F.lit(FILTER_BITS))
    words = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def _candidate_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``c, n, sketch, hashes`` of the classes whose row hashes are wanted (and a few more)."""
    bits = rows.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches):
        recent = _Recent()
        for batch in batches:
            h = batch.column(0).to_numpy() % FILTER_BITS
            rows = batch.filter(pa.array((bits.value[h >> 6] >> (h & 63)) & 1 == 1))
            out = [(c, len(s), parity_bits(s).tolist(), pa.array(s.view(np.int64))) for _, s in shingle_sets(utf8(rows.column(1)), width) if len(s) and recent.new(c := identity(s))]
            if out:
                lengths = np.cumsum([0] + [x[1] for x in out])
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.concat_arrays([x[3] for x in out]))], names=["c", "n", "sketch", "hashes"])

    found = mapped(rows.select("h", "text"), run, "c long, n long, sketch array<long>, hashes array<long>")
    return written(found.dropDuplicates(["c"]), "sets")


def _merge(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join by sorting, not by a broadcast."""
    return table.hint("merge")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose sizes and parity sketches allow a link; no shingle set is read."""
    named = lambda c: sets.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    joined = pairs.select("u", "v").join(_merge(named("u")), "u").join(_merge(named("v")), "v")
    joined = joined.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    apart = F.aggregate(F.zip_with("su", "sv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x)
    return joined.where(apart * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent)).select("u", "v")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of distinct classes that link, by exact intersection of their sets.

    A class in many pairs is dealt over up to 256 parts, so that no task gets all its pairs.
    """
    salted = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(256)).alias("_s"))
    mine = salted.join(_merge(sets.select(F.col("c").alias("v"), F.col("n").alias("nv"), F.col("hashes").alias("hv"))), "v")
    combos = salted.select("u", "_s").distinct()
    theirs = combos.join(_merge(sets.select(F.col("c").alias("u"), F.col("n").alias("nu"), F.col("hashes").alias("hu"))), "u")
    both = F.size(F.array_intersect("hu", "hv"))
    joined = mine.join(_merge(theirs), ["u", "_s"]).where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return joined.where(both * 100 >= percent * (F.col("nu") + F.col("nv") - both)).select("u", "v")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs whose classes have different roots."""
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    joined = pairs.join(_merge(named("u")), "u", "left").join(_merge(named("v")), "v", "left")
    return joined.where(F.coalesce("_u", "u") != F.coalesce("_v", "v")).drop("_u", "_v")


def _near(members: DataFrame, percent: int, most: int | None) -> DataFrame:
    """``u, v``: pairs of different components within a group whose sizes and sketches allow a link;
    of each class only the ``most`` nearest by sketch, if that is given."""

    def run(batches):
        held: list[tuple] = []
        group = None

        def pairs():
            part, c, root, n = (np.array([h[x] for h in held]) for x in range(4))
            sketch = np.stack([np.frombuffer(h[4], np.uint64) for h in held])
            found = set()
            for i in range(len(c)):
                ok = (root != root[i]) & ((part != part[i]) | (group[1] == group[2])) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
                at = np.flatnonzero(ok)
                apart = np.bitwise_count(sketch[at] ^ sketch[i]).sum(1)
                near = apart <= (n[at] + n[i]) * (100 - percent) // (100 + percent)
                at, apart = at[near], apart[near]
                if most is not None:
                    at = at[np.lexsort((c[at], apart))[:most]]
                found.update((min(c[i], c[k]), max(c[i], c[k])) for k in at)
            return found

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([p[x] for p in out], pa.int64()) for x in (0, 1)], names=["u", "v"])

        for batch in batches:
            for key, i, j, part, c, root, n, sketch in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (key, i, j) != group:
                    if len(held) > 1 and (out := pairs()):
                        yield batch_of(out)
                    held, group = [], (key, i, j)
                held.append((part, c, root, n, sketch))
        if len(held) > 1 and (out := pairs()):
            yield batch_of(out)

    return mapped(members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "u long, v long").distinct()


def _mixed_keys(stars: DataFrame, apart: DataFrame) -> DataFrame:
    """``key, c``: the classes of the keys that hold a pair of ``apart``, but for each key's smallest, which all were compared with."""
    keys = stars.join(_merge(apart.select(F.col("u").alias("a"), F.col("v").alias("x"))), ["a", "x"], "left_semi").select("key").distinct()
    return stars.join(_merge(keys), "key", "left_semi").select("key", F.col("x").alias("c"))


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs within the keys of ``members`` that are left to verify."""
    placed = members.join(_merge(roots.select(F.col("node").alias("c"), "root")), "c", "left").withColumn("root", F.coalesce("root", "c"))
    # keys with the same members are one group, and only groups of several components matter
    hashed = F.xxhash64("c").cast("decimal(38,0)")
    groups = placed.groupBy("key").agg(F.count("*").alias("m"), F.sum(hashed).alias("sum"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    groups = groups.groupBy("m", "sum").agg(F.min("key").alias("key"))
    held = placed.join(_merge(groups.select("key", "m")), "key")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    part = F.pmod(F.xxhash64("c"), chunks).cast("int")
    dealt = held.select("key", "c", "root", part.alias("part"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "c", "root")
    sketch = F.unhex(F.array_join(F.transform("sketch", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    full = dealt.join(_merge(sets.select("c", "n", sketch.alias("sketch"))), "c")
    return _near(full.select("key", "i", "j", "part", "c", "root", "n", "sketch"), percent, most)


def _few(members: DataFrame) -> tuple[bool, int]:
    """Whether all pairs within the keys are at most ``LISTED`` for each member, and the number of members."""
    m = F.col("count")
    n, pairs = members.groupBy("key").count().agg(F.sum(m), F.sum((m * (m - 1)).cast("decimal(38,0)"))).first()
    return (pairs or 0) <= 2 * LISTED * (n or 0), n or 0


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written table of those of the pairs that link: first by sketch, then by their sets."""
    possible = written(_possible(pairs, sets, percent), "possible")
    links = written(_links(possible, sets, percent), "links")
    discard(possible)
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``doc_id, h, n, c`` for every row, and ``c, component_id, root`` for every class."""
    rows = pick(docs, {"doc_id": id_col, "text": text_col})
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    sized = written(_sizes(rows, width), "sizes")
    stars = written(_stars(_keys(rows, width, percent)), "stars")
    pairs = written(stars.groupBy("a", "x").agg(F.count("*").alias("shared")).select(F.col("a").alias("u"), F.col("x").alias("v"), "shared"), "pairs")
    involved = pairs.select(F.col("u").alias("c")).union(pairs.select(F.col("v").alias("c"))).distinct()
    wanted = sized.where("c is not null").groupBy("c").agg(F.min("h").alias("h")).join(_merge(involved), "c", "left_semi")
    sets = _candidate_sets(rows, wanted, width)

    likely = pairs.groupBy("v").agg(F.max(F.struct("shared", "u")).alias("_b")).select(F.col("_b.u").alias("u"), "v")
    links = _verified(likely, sets, percent)
    roots = components(links)
    others = _apart(pairs.join(_merge(likely), ["u", "v"], "left_anti").select("u", "v"), roots)
    more = _verified(others, sets, percent)
    if not more.isEmpty():
        roots = components(_as_edges(roots).union(more))
    apart = written(_apart(pairs.select("u", "v"), roots), "apart")
    if not apart.isEmpty():
        members, tested = written(_mixed_keys(stars, apart), "members"), pairs.select("u", "v")
        ahead: list[int | None] = [1, 4, None]  # nearest first, so that components grow before the rest is listed
        few, most = _few(members)
        left = written(_rest(members, roots, sets, percent, None).join(_merge(tested), ["u", "v"], "left_anti"), "left") if few else None
        if left is not None and left.count() <= most:
            ahead = []
            more = written(_links(left, sets, percent), "links")
            if not more.isEmpty():
                roots = components(_as_edges(roots).union(more))
        while ahead:
            left = written(_rest(members, roots, sets, percent, ahead.pop(0)).join(_merge(tested), ["u", "v"], "left_anti"), "left")
            more = written(_links(left, sets, percent), "links")
            tested = tested.union(left)
            if more.isEmpty():
                ahead = ahead[-1:]
            else:
                roots = components(_as_edges(roots).union(more))
        discard(members)
    discard(stars, pairs, sets, links, apart)

    by_class = sized.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    named = by_class.join(_merge(roots.select(F.col("node").alias("c"), "root")), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = written(named, "classes")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = written(named.join(_merge(ids), "root").select("c", "component_id", "root"), "components")
    discard(named)
    return sized, found


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id reachable by links, for every row."""
    sized, by_class = classes(docs, id_col, text_col, width, percent)
    joined = sized.join(_merge(by_class.select("c", "component_id")), "c", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the smallest id (of equal rows, one).

    Rows without shingles stay.
    """
    names = docs.columns
    sized, by_class = classes(docs, id_col, text_col, width, percent)
    joined = sized.where("c is not null").join(_merge(by_class.select("c", "root")), "c")
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("_f")).select(F.col("_f.h").alias("_h"))
    plain = pick(docs, {"_id": id_col, "_text": text_col} | {f"_c{i}": c for i, c in enumerate(names)}).withColumn("_h", F.xxhash64("_id", "_text"))
    blank = F.coalesce(~F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = plain.where(~blank).join(_merge(first), "_h", "left_semi")
    one = kept.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(F.lit(0)))).where("_r = 1").drop("_r")
    return plain.where(blank).unionByName(one).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
