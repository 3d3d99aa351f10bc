"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of ``BITS`` bits link at ``radius`` or fewer differing bits. The bits are grouped into m partitions,
correlated bits together, and partition i gets a threshold t_i with sum(t_i) = radius - m + 1: two linked fingerprints
then differ in at most t_i bits of some partition i. Partitions, m and the unequal thresholds (-1: never probed) are
chosen by dynamic programming over estimated probe and candidate counts, which come from all distinct fingerprints.
A partition with t_i = 0 compares the fingerprints that share a value; one with more probes each value's neighbours.
Candidates are verified by their whole fingerprints inside the task that groups them; only links leave it, of dense
groups only a spanning forest. Values that too many fingerprints share are split into pairs of blocks.

Components come from alternating large-star and small-star steps over the links, each round written to the shared
folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
SEED = 42
RADIUS = 3
SHINGLE = 3
#: Fingerprints of one value that are compared in one task; more are split into blocks.
BLOCK = 8192
#: A probe row costs as much as so many comparisons inside a task.
PROBE_COST = 50
PARTITION_COUNTS = (2, 3, 4, 5, 6)
_SMALL = 64
#: Groups with more links than so many for each fingerprint are told by a spanning forest.
LINKS_EACH = 16
#: For groups by similarity: words of a shingle, least Jaccard similarity.
WORDS, SIMILARITY = 5, 0.8
#: These bear on its cost only: least hashes of a text that are tried first, shingles counted at once, and the shingles
#: ordered by their counts: from which count, and how many at most.
STARS, CHUNK, OFTEN, MOST_ORDERED = 4, 2_000_000, 8, 200_000
#: Bits of a set's sketch; shingles of a text that tell whether a pair has been seen before.
SKETCH_BITS = 512
EARLY = 8


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Of a whole text's UTF-8 bytes; 0 if it has no words."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        texts = [b" ".join(words)]
    else:
        texts = [b" ".join(x) for x in zip(*[words[i:] for i in range(shingle)])]
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.fromiter((digest(t, SEED) for t in texts), np.uint64, len(texts)))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of each row; a null or empty text has fingerprint zero."""
    slim = docs.select(F.col(id_col), common.text_or_empty(text_col).cast("binary").alias("raw"))
    schema = slim.select(F.col(id_col), F.lit(0).cast("long").alias("fp")).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return slim.mapInArrow(batches, schema)


# ---- choosing partitions and thresholds


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often bit i and bit j are both set, over all rows; each task adds up its own."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for b in it:
            fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(fp), 1 << 16):
                x = np.unpackbits(fp[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
        cell = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(both.ravel().astype(np.int64))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(batches, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` partitions of nearly equal size: each starts at the bit most correlated with those left and takes the
    bits most correlated with its own."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = sorted(left)
        part = [max(rest, key=lambda b: corr[b, rest].sum())]
        left.remove(part[0])
        while len(part) < size:
            b = max(sorted(left), key=lambda b: corr[b, part].sum())
            part.append(b)
            left.remove(b)
        parts.append(sorted(part))
    return parts


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@dataclass(frozen=True)
class Plan:
    """parts: bits and threshold of each partition that is probed; cost: as estimated."""

    parts: tuple[tuple[tuple[int, ...], int], ...]
    cost: float


def allocate(parts: list[list[int]], pairs0: list[float], odds: np.ndarray, n: int, radius: int) -> Plan:
    """The cheapest thresholds with sum radius - m + 1. pairs0: pairs of fingerprints with equal values, by partition;
    odds: by bit, of a pair's differing there."""
    m, total = len(parts), radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, pairs in zip(parts, pairs0, strict=True):
        sums = np.zeros(radius + 1)  # elementary symmetric polynomials of the odds
        sums[0] = 1
        for b in bits:
            sums[1:] = sums[1:] + odds[b] * sums[:-1]
        costs = {-1: 0.0}
        for t in range(min(radius, len(bits)) + 1):
            probes = sum(comb(len(bits), j) for j in range(t + 1)) + (t > 0)
            costs[t] = PROBE_COST * max(n, 1) * probes + pairs * float(sums[: t + 1].sum())
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t, c in costs.items():
                if have + t not in step or cost + c < step[have + t][0]:
                    step[have + t] = (cost + c, [*chosen, t])
        best = step
    cost, chosen = best[total]
    return Plan(tuple((tuple(b), t) for b, t in zip(parts, chosen, strict=True) if t >= 0), cost)


def make_plan(fps: DataFrame, n: int, radius: int) -> Plan:
    """From counts over all rows of ``fps`` (fp, distinct)."""
    both = bit_counts(fps)
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    odds = differ / np.maximum(1 - differ, 1e-9)
    schemes = [correlated_parts(both, n, m) for m in PARTITION_COUNTS if m <= radius + 1]
    masks = [signed(mask_of(bits)) for parts in schemes for bits in parts]
    keyed = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in masks])).alias("part", "key"))
    sizes = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = dict(sizes.groupBy("part").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).collect())
    plans, at = [], 0
    for parts in schemes:
        plans.append(allocate(parts, [pairs.get(at + i) or 0.0 for i in range(len(parts))], odds, n, radius))
        at += len(parts)
    return min(plans, key=lambda x: x.cost)


# ---- candidates and links


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def dense_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between ``left`` and ``right``, or a spanning forest of them if they are very many."""
    rows, room = max(1, (1 << 22) // max(len(right), 1)), LINKS_EACH * (len(left) + len(right))
    a, b = [], []
    for at in range(0, len(left), rows):
        i, j = np.nonzero(close_pairs(left[at : at + rows, None], right[None, :], radius))
        apart = left[at + i] != right[j]
        a.append(left[at + i[apart]])
        b.append(right[j[apart]])
        room -= len(a[-1])
        if room < 0:
            return forest(left, right, radius)
    return np.concatenate(a), np.concatenate(b)


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links between ``left`` and ``right``, without holding all pairs."""
    nodes = np.unique(np.concatenate([left, right]))
    li, ri = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    label = np.arange(len(nodes))
    rows = max(1, (1 << 22) // max(len(right), 1))
    while True:
        before = label.copy()
        for at in range(0, len(left), rows):
            near = close_pairs(left[at : at + rows, None], right[None, :], radius)
            i, j = np.nonzero(near)
            x, y = li[at + i], ri[j]
            low = np.minimum(label[x], label[y])
            for node in (x, y, label[x], label[y]):
                np.minimum.at(label, node, low)
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]


def linked(group: np.ndarray, probe: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal ``group`` values. probe: 0 index and 1 probe rows, which are compared with each
    other; -1 rows are compared among themselves."""
    n = len(fp)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes, sizes) <= _SMALL
    a, b = [], []
    for d in range(1, min(_SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[: n - d] & (group[: n - d] == group[d:]))
        if not len(i):
            break
        i = i[((probe[i] < 0) | (probe[i] != probe[i + d])) & (fp[i] != fp[i + d]) & close_pairs(fp[i], fp[i + d], radius)]
        a.append(fp[i])
        b.append(fp[i + d])
    for s, size in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        f, q = fp[s : s + size], probe[s : s + size]
        p, i = np.flatnonzero(q != 0), np.flatnonzero(q < 1)
        if len(p) and len(i):
            x, y = dense_links(np.unique(f[p]), np.unique(f[i]), radius)
            a.append(x)
            b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _link_batches(radius: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.int64, np.int8, np.uint64)
        held = tuple(np.zeros(0, t) for t in kinds)

        def links(cols):
            part, key, sub, probe, fp = cols
            new = np.ones(len(fp), bool)
            new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
            a, b = linked(np.cumsum(new), probe, fp, radius)
            low, high = np.minimum(a, b), np.maximum(a, b)
            if len(low):
                pairs = np.unique(np.stack([low, high], 1), axis=0)
                low, high = pairs[:, 0], pairs[:, 1]
            return pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["a", "b"])

        for batch in it:
            got = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            cols = [np.concatenate([h, g.view(np.uint64) if h.dtype == np.uint64 else g.astype(h.dtype)]) for h, g in zip(held, got, strict=True)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            if cols[3][-1] < 0:  # compared among themselves: wait for the rest, which blocks bound
                held = tuple(c[last] for c in cols)
                cols = [c[~last] for c in cols]
            else:  # index rows come first: probes need not be held
                held = tuple(c[last & (cols[3] == 0)] for c in cols)
            yield links(cols)
        yield links(held)
        del held
        pa.default_memory_pool().release_unused()  # the worker lives on

    return batches


def links(fps: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a below b as unsigned numbers, of which the links' components are those of all links.

    ``fps``: (fp) distinct, ``n`` of them. Links are complete but inside one value's dense group, where a spanning forest stands for them."""
    spark = fps.sparkSession
    plan = make_plan(fps, n, radius)
    rows, index = None, None
    for k, (bits, t) in enumerate(plan.parts):
        mask = signed(mask_of(bits))
        own = fps.select(F.lit(k).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"), F.lit(0 if t else -1).cast("byte").alias("probe"), "fp")
        index = own if index is None else index.unionAll(own)
        if t:
            flips = [signed(mask_of(c)) for j in range(t + 1) for c in combinations(bits, j)]
            probes = fps.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(
                F.lit(k).cast("long").alias("part"), F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(mask)).alias("key"), F.lit(1).cast("byte").alias("probe"), "fp"
            )
            own = own.unionAll(probes)
        rows = own if rows is None else rows.unionAll(own)
    hot = common.materialize(
        index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > block).select("part", "key", F.ceil(F.col("c") / block).cast("long").alias("blocks")),
        "hot",
    )
    n_hot = hot.count()
    if n_hot:
        small = n_hot <= 100_000  # else a shuffled join
        rows = rows.join(F.broadcast(hot) if small else hot, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        rows = rows.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        sub = (
            F.when(F.col("probe") < 0, F.least("i", "j") * F.col("blocks") + F.greatest("i", "j"))
            .when(F.col("probe") == 0, F.col("i") * F.col("blocks") + F.col("j"))
            .otherwise(F.col("j") * F.col("blocks") + F.col("i"))
        )
        rows = rows.select("part", "key", sub.alias("sub"), "probe", "fp")
    else:
        rows = rows.select("part", "key", F.lit(0).cast("long").alias("sub"), "probe", "fp")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "part", "key", "sub").sortWithinPartitions("part", "key", "sub", "probe")
    return dealt.mapInArrow(_link_batches(radius), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of each node's component. ``edges``: (a, b), repeats allowed."""

    def low_of(pairs: DataFrame) -> DataFrame:  # beside each (u, v), the least of u and its neighbours
        low = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "at")
        return pairs.join(low, pairs["u"] == low["at"]).withColumn("low", F.least("low", "u"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    now = common.materialize(edges.filter("a <> b").distinct(), "edges")
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = print_of(now)
    for _ in range(most_rounds):
        large = low_of(both(now)).filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        large = common.materialize(large.filter("a <> b").distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = low_of(down)
        small = low.select(F.col("v").alias("a"), F.col("low").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
        now = common.materialize(small.filter("a <> b").distinct(), "small")
        found = print_of(now)
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components have not converged")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """(id, fingerprint, component_id) of each row of ``docs``.

    Null ids take part, but never name a component that has another; rows that repeat an id have a fingerprint each. Null
    and empty texts have fingerprint zero; texts of any length are read whole. Other columns aren't read. Empty table:
    empty result.
    """
    marked = common.materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    by_fp = common.materialize(marked.groupBy("fp").agg(F.min(id_col).alias("low_id"), F.count(F.lit(1)).alias("docs")), "by_fp")
    n, total = by_fp.agg(F.count(F.lit(1)), F.sum("docs")).first()
    roots = components(links(by_fp.select("fp"), n, radius, block))
    rooted = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", "low_id", "docs", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    table = common.materialize(rooted.join(low, "root").select("fp", "docs", "component_id"), "components")
    out = common.lookup_join(marked, table, ["fp"], "docs", total or 0)
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- groups by similarity


def shingle_hashes(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; of the whole sequence if it is shorter, none if it is empty."""
    w = raw.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    texts = {b" ".join(x) for x in zip(*[w[i:] for i in range(words)])} if len(w) > words else {b" ".join(w)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts)))


def _shingle_sets(words: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingle_hashes(x.as_py(), words).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return batches


def _similar(least: float):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return batches


def sketch(hashes: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each bit: two sketches differ in at most as many bits as their sets
    in shingles."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _possible(least: float):
    """Drops the pairs whose sizes or sketches rule out the similarity."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            differ = np.maximum(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), np.abs(n - m))
            keep = pa.array(differ <= (1 - least) / (1 + least) * (n + m) + 1e-6)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return batches


def _describe(words: int):
    """Of each text (node, digest of its set, its fingerprint, size, sketch and least hashes); and (token, n) of the shingles that several texts of
    a chunk have."""
    schema = pa.schema([("node", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("least", pa.list_(pa.int64())), ("token", pa.int64()), ("n", pa.int64())])

    def rows(many: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(many, f.type) for f in schema], schema=schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def common_ones() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return rows(int((n > 1).sum()), token=pa.array(token[n > 1].view(np.int64)), n=pa.array(n[n > 1]))

        for b in it:
            digests, fps, sizes, sketches, least = [], [], [], [], []
            for x in b.column(1):
                s = shingle_hashes(x.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                fps.append(signed(fingerprint_of(s)))
                sizes.append(len(s))
                sketches.append(sketch(s))
                least.append(s[:STARS].view(np.int64))
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield common_ones()
                    size = 0
            yield rows(b.num_rows, node=b.column(0), digest=pa.array(digests, pa.binary()), fp=pa.array(fps, pa.int64()), size=pa.array(sizes, pa.int64()), sketch=pa.array(sketches, pa.binary()), least=pa.array(least, pa.list_(pa.int64())))
        yield common_ones()

    return batches


def prefix(hashes: np.ndarray, tokens: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, so many that two sets of similarity ``least`` share one of them.
    tokens: sorted, with their counts; others count as none."""
    at = np.minimum(np.searchsorted(tokens, hashes), max(len(tokens) - 1, 0))
    n = np.where(tokens[at] == hashes, counts[at], 0) if len(tokens) else np.zeros(len(hashes), np.int64)
    order = np.lexsort([hashes, n])
    return hashes[order[: len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1]]


def _prefixes(words: int, shared, least: float):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        for b in it:
            sets = [shingle_hashes(x.as_py(), words) for x in b.column(1)]
            firsts = [prefix(s, tokens, counts, least).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(firsts, pa.binary())], names=["node", "size", "firsts"])

    return batches


def _postings(shared, block: int):
    """(token, sub, place, size, node, label) of each prefix; the texts of a token that more than ``block`` share are
    split into pairs of blocks, numbered by ``sub``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        tokens, blocks = tokens[counts > block], -(-counts[counts > block] // block)
        for b in it:
            firsts = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(2)]
            lengths = np.array([len(x) for x in firsts], np.int64)
            if not lengths.sum():
                continue
            token = np.concatenate(firsts)
            place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            node, size, label = (np.repeat(b.column(i).to_numpy(), lengths) for i in (0, 1, 3))
            many = np.ones(len(token), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
                many = np.where(tokens[at] == token, blocks[at], 1)
            row = np.repeat(np.arange(len(token)), many)
            j = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            i = np.array([xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True)) for x in node[row]], np.uint64) % many[row].astype(np.uint64) if len(row) > len(token) else j
            i = i.astype(np.int64)
            sub = np.minimum(i, j) * many[row] + np.maximum(i, j)
            for k in range(0, len(row), 1 << 18):
                r = row[k : k + (1 << 18)]
                cols = [token.view(np.int64)[r], sub[k : k + (1 << 18)], place[r].astype(np.int32), size[r].astype(np.int32), node[r], label[r]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_POSTING)

    return batches


_POSTING = ["token", "sub", "place", "size", "node", "label"]
_POSTING_TYPES = "token long, sub long, place int, size int, node long, label long"


def overlapping(group: np.ndarray, place: np.ndarray, size: np.ndarray, label: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside each run of equal ``group`` values, of different labels, that can be as similar as
    ``least`` if the shared token is the first one they share; in bounded lots."""
    n = len(group)
    left, share = size - place, least / (1 + least)

    def apart(i, j):
        return (label[i] != label[j]) & (np.minimum(left[i], left[j]) >= share * (size[i] + size[j]) - 1e-6)

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes, sizes) <= _SMALL
    for d in range(1, min(_SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[: n - d] & (group[: n - d] == group[d:]))
        if not len(i):
            break
        i = i[apart(i, i + d)]
        yield i, i + d
    for s, many in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        labels, at = np.unique(label[s : s + many], return_inverse=True)
        rest = s + np.flatnonzero(at != np.bincount(at).argmax())  # the largest group's texts need no comparison
        every = np.arange(s, s + many)
        rows = max(1, (1 << 18) // many)
        for k in range(0, len(rest) if len(labels) > 1 else 0, rows):
            i, j = np.nonzero(apart(rest[k : k + rows, None], every[None, :]))
            yield rest[k + i], every[j]


def _by_token(work):
    """``work`` on whole groups of postings, which come in order of their token and sub. Its columns are numpy arrays."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def numbers(column: pa.Array) -> np.ndarray:
            if pa.types.is_integer(column.type):
                return column.to_numpy()
            if pa.types.is_list(column.type):  # of at most EARLY numbers, filled up with zeros
                lengths = column.value_lengths().to_numpy()
                out = np.zeros((len(column), EARLY), np.int64)
                out[np.arange(EARLY) < lengths[:, None]] = column.flatten().to_numpy()
                return out
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

        def groups(cols):
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            return work(np.cumsum(new), cols)

        for batch in it:
            if not batch.num_rows:
                continue
            cols = [numbers(c) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            held = [c[last] for c in cols]
            if not last.all():
                yield from groups([c[~last] for c in cols])
        if held is not None:
            yield from groups(held)
        del held
        pa.default_memory_pool().release_unused()  # the worker lives on

    return batches


def _live(least: float):
    """The postings that are in a pair at all."""

    def work(group, cols):
        _, _, place, size, _, label = cols
        live = np.zeros(len(group), bool)
        for i, j in overlapping(group, place, size, label, least):
            live[i] = live[j] = True
        if live.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[live]) for c in cols], names=_POSTING)

    return _by_token(work)


def seen_before(token: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two texts meet at another shingle before ``token``. a, b: the first of their live shingles, in the common
    order, filled up with zeros: the first that both have is ``token``, or comes before it."""
    both = (a[:, :, None] == b[:, None, :]).any(2) & (a != 0)
    return both.any(1) & (a[np.arange(len(a)), both.argmax(1)] != token)


def _pairs(least: float):
    """The pairs that their sketches don't rule out, most of them at the first shingle that they share only."""

    def work(group, cols):
        token, _, place, size, node, label, sketches, early = cols
        most = (1 - least) / (1 + least)
        for i, j in overlapping(group, place, size, label, least):
            if not len(i):
                continue
            differ = np.bitwise_count(sketches[i] ^ sketches[j]).sum(1, dtype=np.int64)
            possible = differ <= most * (size[i] + size[j]) + 1e-6
            i, j = i[possible], j[possible]
            new = ~seen_before(token[i], early[i], early[j])
            a, b = node[i[new]], node[j[new]]
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return _by_token(work)


def fingerprint_links(texts: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs of texts (a, b), a below b, that join all whose fingerprints link: each with the first of its fingerprint,
    and the first ones of linked fingerprints. ``texts``: (node, fp), nodes distinct, written to stay as they are."""
    by_fp = common.materialize(texts.groupBy("fp").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("docs")), "by_fp")
    n, total = by_fp.agg(F.count(F.lit(1)), F.sum("docs")).first()
    same = common.lookup_join(texts, by_fp, ["fp"], "docs", total or 0).filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    close = common.materialize(links(by_fp.select("fp"), n, radius, block).distinct(), "links")
    many = close.count()

    def ends(facts: DataFrame, side: str) -> DataFrame:  # a dense group's links share an end
        table = close.groupBy(side).agg(F.count(F.lit(1)).alias("uses")).join(by_fp.select(F.col("fp").alias(side), F.col("centre").alias(f"node_{side}")), side)
        return common.lookup_join(facts, table, [side], "uses", many)

    pairs = ends(ends(close, "a"), "b")
    return same.unionAll(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def similar_rows(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, root) of the nodes that aren't the smallest of their group, and that smallest node. ``rows``: (node long,
    raw binary), written to stay as they are, nodes distinct and not null. Groups are joined by all pairs whose sets of
    ``words``-word shingles have a Jaccard similarity of at least ``similarity`` (above 0).

    Groups are those of SimHash first: fingerprints of the sets, linked by the generalised pigeonhole, each link between
    texts verified. Two sets so similar may yet have fingerprints further apart than ``RADIUS``, or a link of a dense
    group may stand for others; an exact way for these follows, between texts that aren't in one group so far. Its
    candidates are complete by prefix filtering: in any common order of the shingles, two sets so similar share one
    among the first of each. Rare ones come first, which bears on the cost only. Texts with equal sets are one."""
    spark = rows.sparkSession
    described = common.materialize(rows.mapInArrow(_describe(words), "node long, digest binary, fp long, size long, sketch binary, least array<long>, token long, n long"), "described")
    sets = described.filter("node IS NOT NULL")
    by_set = common.materialize(sets.groupBy("digest").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("docs")), "by_set")
    total = by_set.agg(F.sum("docs")).first()[0] or 0
    own = common.materialize(common.lookup_join(sets.select("node", "digest", "fp", "least"), by_set, ["digest"], "docs", total).select("node", "rep", "fp", "least"), "own")
    same = own.filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    reps = own.filter("node = rep")
    hot = described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n")).limit(MOST_ORDERED).toArrow()
    tokens, counts = np.ascontiguousarray(hot.column("token").to_numpy()).view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[order], counts[order]))

    def possible(edges: DataFrame) -> DataFrame:
        of = lambda x: sets.select(F.col("node").alias(f"n{x}"), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        sketched = edges.distinct().join(of("a"), F.col("a") == F.col("na")).join(of("b"), F.col("b") == F.col("nb")).select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        return sketched.mapInArrow(_possible(similarity), "a long, b long")

    def verified(edges: DataFrame) -> DataFrame:
        edges = common.materialize(edges, "candidates", release=True)
        ends = common.materialize(edges.select(F.col("a").alias("end")).distinct().unionAll(edges.select("b").distinct()).distinct(), "ends")  # its size tells whether to broadcast it
        texts = rows.join(ends, F.col("node") == F.col("end"), "left_semi")
        found = common.materialize(texts.mapInArrow(_shingle_sets(words), "node long, shingles binary"), "shingles")
        side = lambda x: found.select(F.col("node").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
        both = edges.join(side("a"), F.col("a") == F.col("na")).join(side("b"), F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")
        return common.materialize(both.mapInArrow(_similar(similarity), "a long, b long"), "verified", release=True)

    # SimHash's links, and each text with the first one that shares a least hash: inside the groups so made no pairs are needed
    linked_ = fingerprint_links(reps.select("node", "fp"), block=block)
    least = reps.select("node", F.explode("least").alias("token"))
    stars = common.materialize(least.groupBy("token").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("docs")).filter("docs > 1"), "stars")
    stars = common.lookup_join(least, stars, ["token"], "docs", stars.agg(F.sum("docs")).first()[0] or 0).filter("centre < node")
    close = verified(possible(linked_.unionAll(stars.select(F.col("centre").alias("a"), F.col("node").alias("b")))))
    packed = rows.mapInArrow(_prefixes(words, shared, similarity), "node long, size long, firsts binary").join(reps.select(F.col("node").alias("own")), F.col("node") == F.col("own"), "left_semi")
    roots = components(close).withColumnRenamed("node", "member")
    labelled = common.materialize(packed.join(roots, F.col("node") == F.col("member"), "left").select("node", "size", "firsts", F.coalesce("root", "node").alias("label")), "prefixes", release=True)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_token = lambda x: x.repartition(width, "token", "sub").sortWithinPartitions("token", "sub")
    postings = by_token(labelled.mapInArrow(_postings(shared, block), _POSTING_TYPES))
    live = common.materialize(postings.mapInArrow(_live(similarity), _POSTING_TYPES), "live", release=True)  # most postings have no partner
    early = live.groupBy(F.col("node").alias("own")).agg(F.array_sort(F.collect_set(F.struct("place", "token"))).alias("all")).select("own", F.slice("all.token", 1, EARLY).alias("early"))
    early = early.join(sets.select(F.col("node").alias("its"), "sketch"), F.col("own") == F.col("its"))
    sketched = live.join(early, F.col("node") == F.col("own")).select(*_POSTING, "sketch", "early")
    wide = verified(by_token(sketched).mapInArrow(_pairs(similarity), "a long, b long").distinct())  # a pair may come more than once
    return components(close.unionAll(wide).unionAll(same))


def followers(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, id, component_id) of all but the first row of each group, by id (null last), then by node. ``rows``:
    (node, id); ``roots``: as ``similar_rows`` gives them."""
    members = roots.select("node", "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    members = common.materialize(members.withColumnRenamed("node", "member").join(rows, F.col("member") == F.col("node")).select("node", "id", "root"), "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"), F.count(F.lit(1)).alias("docs"))
    first = common.materialize(first.select("root", F.col("first.id").alias("component_id"), F.col("first.node").alias("first_node"), "docs"), "firsts")
    out = common.lookup_join(members, first, ["root"], "docs", members.count())
    return out.filter("node <> first_node").select("node", "id", "component_id")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, component_id) of the rows that follow another in a group (the first one isn't listed): joined by all pairs
    whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``.

    Rows are told apart by a number of their own, so repeated and null ids are rows like others; a group is named by
    its smallest id, null only if it has no other. Empty and null texts are alike. Texts of any length are read whole.
    Other columns aren't read. Empty table: empty result."""
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("id"), common.text_or_empty(text_col).cast("binary").alias("raw"))
    rows = common.materialize(rows, "texts")
    found = followers(rows.select("node", "id"), similar_rows(rows.select("node", "raw"), words, similarity, block))
    return found.select(F.col("id").alias(id_col), "component_id")


def query(spark, sf_dir):
    return near_groups(common.documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: of each group of near-duplicates the row with the smallest id stays. Near are documents whose
    shingles of five words have a similarity of 0.8 or more; SimHash finds the groups, an exact way what it can't see. Groups are of rows, not of ids; nulls and long texts are as
    in ``similar_groups``. Columns of any name pass as they are."""
    node = common.fresh_name(docs.columns, "node")
    rows = common.materialize(docs.select(F.monotonically_increasing_id().alias(node), *docs.columns), "documents")
    texts = rows.select(F.col(node).alias("node"), common.text_or_empty("text").cast("binary").alias("raw"))
    go = followers(rows.select(F.col(node).alias("node"), F.col("doc_id").alias("id")), similar_rows(texts)).select(F.col("node").alias("go"))
    return rows.join(go, F.col(node) == F.col("go"), "left_anti").select(*docs.columns)
