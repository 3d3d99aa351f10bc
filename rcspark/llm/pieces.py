"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units wherever no piece can reach across, that is between two characters that are neighbours in no
piece, and only distinct units are encoded. Their substrings, up to the longest piece, are exploded and equi-joined
to the piece table (broadcast: its size is the vocabulary's); the edges found are grouped by unit and folded with
Spark's higher-order ``aggregate``:

* ``unigram`` models: Viterbi, the path with the highest sum of scores;
* ``bpe`` models: a sum of scores isn't what such a model means, so Viterbi can't give its segmentation. The same
  edges are folded in merge order instead: an edge is applied when both its ends and exactly one inner point are still
  boundaries. Edges come by rank and place; some pieces may have to be applied after a piece of a worse rank made
  them possible, and units in which that happens are folded again step by step.

Such folds take time that grows with the square of a unit's length or faster, so units of over ``LONG`` characters are
folded outside SQL, by the same rules, in nearly linear time.

Frequent units' ids are broadcast, at most ``head`` of bounded length; the others of a text come by a join, of which
hot keys are spread. Texts travel once, compressed.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "\u2581"
#: Parameters: units with broadcast ids and their longest length, units of a partition.
HEAD = 300_000
HEAD_CHARS = 32
PARTITION_UNITS = 20_000
#: Units up to this length keep their boundaries in the bits of a number, longer ones in a string, and over ``LONG`` in
#: a linked list outside SQL.
SHORT = 60
LONG = 200
#: Characters that are cut at once, and rows of counts that a task holds.
CHUNK_CHARS = 1 << 20
_COUNT_CHARS = 1 << 19
_COUNTED_ROWS = 600_000
_COMPARED = 20_000
#: Frequent units that texts are compressed against, for their way through the shuffle.
_PRIMER_UNITS = 8192
#: Texts that a worker holds at once.
BATCH_ROWS = 1000
_BATCHES = common.small_batches(BATCH_ROWS)

_MODELS: dict[str, "Pieces"] = {}
_HEADS: dict[str, dict[str, bytes]] = {}


@dataclass(frozen=True)
class Pieces:
    """A model's table. rank: place by falling score, equal for equal scores; late: the piece may become possible only
    after a piece of an equal or worse rank."""

    text: tuple[str, ...]
    id: tuple[int, ...]
    score: tuple[float, ...]
    rank: tuple[int, ...]
    late: tuple[bool, ...]
    first_byte: int
    raw: tuple[bytes, ...]
    longest: int

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in range(n)]
        first = next((i for i in range(n) if sp.is_byte(i)), -1)
        return cls.of([sp.id_to_piece(i) for i in plain], plain, [sp.get_score(i) for i in plain], first, raw)

    @classmethod
    def of(cls, text, ids, score, first_byte: int, raw) -> "Pieces":
        order = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
        rank = {t: order[s] for t, s in zip(text, score, strict=True)}

        def late(t: str) -> bool:
            halves = [(t[:k], t[k:]) for k in range(1, len(t))]
            return any(len(x) > 1 and rank[x] >= rank[t] for a, b in halves if (len(a) == 1 or a in rank) and (len(b) == 1 or b in rank) for x in (a, b))

        return cls(tuple(text), tuple(ids), tuple(score), tuple(rank[t] for t in text), tuple(map(late, text)), first_byte, tuple(raw), max(map(len, text), default=1))

    @cached_property
    def ids_of(self) -> dict[str, tuple[int, int, float]]:
        """Of each piece (rank, id, score)."""
        return dict(zip(self.text, zip(self.rank, self.id, self.score, strict=True), strict=True))

    @cached_property
    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of each code point, 0 for those that no piece of several characters has; whether two classes, in one
        number, are neighbours in no piece)."""
        pairs = {x for t in self.text for x in zip(t, t[1:])}
        known = {c: i + 1 for i, c in enumerate(sorted({c for x in pairs for c in x}))}
        classes = np.zeros(0x110000, np.int32)
        cut = np.ones((len(known) + 1, len(known) + 1), bool)
        for c, i in known.items():
            classes[ord(c)] = i
        for x, y in pairs:
            cut[known[x], known[y]] = False
        return classes, cut.ravel()

    def _starts(self, marked: str) -> tuple[np.ndarray, np.ndarray]:
        """(code points, whether a unit starts at each)."""
        classes, cut = self._neighbours
        points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
        at = classes.take(points)
        starts = np.ones(len(points), bool)
        cut.take(at[:-1] * round(len(cut) ** 0.5) + at[1:], out=starts[1:])
        return points, starts

    def chunks(self, texts: list[str], size: int = CHUNK_CHARS) -> Iterator[tuple[list[str], list[int]]]:
        """Marked texts, and whose they are, in lots of about ``size`` characters; longer texts are cut between units."""
        parts, owners, held = [], [], 0
        for k, text in enumerate(texts):
            rest = MARK + text.replace(" ", MARK) if text else ""
            while rest:
                part, look = rest, size
                while len(part) > size and look < len(rest):
                    found = np.flatnonzero(self._starts(rest[:look])[1][1:])
                    part, look = rest[: int(found[-1]) + 1] if len(found) else rest, 4 * look
                    if len(found):
                        break
                parts.append(part)
                owners.append(k)
                held, rest = held + len(part), rest[len(part) :]
                if held >= size:
                    yield parts, owners
                    parts, owners, held = [], [], 0
        if parts:
            yield parts, owners

    def split(self, parts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(the units of all parts, the number of the part of each)."""
        marked = "".join(parts)
        points, starts = self._starts(marked)
        begin = np.cumsum([0, *map(len, parts)])[:-1]
        starts[begin] = True
        first = np.flatnonzero(starts)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        raw = marked.encode("utf-8", "surrogatepass")
        ends = np.cumsum(width, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
        offsets = np.append(ends[first] - width[first], len(raw)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw))
        return units, np.searchsorted(begin, first, "right") - 1

    def units(self, text: str) -> list[str]:
        """What is encoded on its own; their concatenation is the marked text."""
        return [u for parts, _ in self.chunks([text]) for u in self.split(parts)[0].to_pylist()]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.text, self.id, self.score, self.rank, self.late, strict=True))
        return spark.createDataFrame(rows, "piece string, id int, score double, rank int, late boolean")

    def segment(self, unit: str, kind: str) -> list[int]:
        """The ids of one unit, by the same rules as the lattice's folds."""
        ends = (_merged if kind == "bpe" else _cheapest)(unit, self)
        out: list[int] = []
        for s, e in zip([0, *ends], ends):
            found = self.ids_of.get(unit[s:e])
            if found:
                out.append(found[1])
            else:
                out += [b + self.first_byte for b in unit[s:e].encode("utf-8", "surrogatepass")] if self.first_byte >= 0 else [0]
        return out

    def decode(self, ids) -> str:
        """Ids as text; bytes that aren't UTF-8 are replaced."""
        marked = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return marked[1:] if marked[:1] == " " else marked


def _merged(unit: str, pieces: Pieces) -> list[int]:
    """Ends of the segments: of neighbours that together are a piece, those of the best rank merge first, the leftmost
    of these before others."""
    n = len(unit)
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    alive = [True] * n + [False]
    known = pieces.ids_of
    heap: list[tuple[int, int, int]] = []

    def offer(s: int) -> None:
        mid = after[s]
        if mid < n and after[mid] - s <= pieces.longest and (found := known.get(unit[s : after[mid]])):
            heapq.heappush(heap, (found[0], s, after[mid]))

    for s in range(n - 1):
        offer(s)
    while heap:
        _, s, e = heapq.heappop(heap)
        mid = after[s]
        if not alive[s] or mid >= n or after[mid] != e:  # it no longer stands so
            continue
        alive[mid] = False
        after[s] = e
        if e <= n:
            before[e] = s
        offer(s)
        if before[s] >= 0:
            offer(before[s])
    ends, at = [], 0
    while at < n:
        at = after[at]
        ends.append(at)
    return ends


def _cheapest(unit: str, pieces: Pieces) -> list[int]:
    """Ends of the segments of the path with the highest sum of scores; the last of equal ones is the longest."""
    low = min(pieces.score, default=0.0) - 10
    best, back = [0.0], [0]
    for e in range(1, len(unit) + 1):
        ways = []
        for s in range(max(0, e - pieces.longest), e):
            found = pieces.ids_of.get(unit[s:e])
            if found or s == e - 1:
                ways.append((best[s] + (found[2] if found else low), e - s))
        top = max(ways)
        best.append(top[0])
        back.append(e - top[1])
    ends, at = [], len(unit)
    while at:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces.load(path)
    return _MODELS[path]


# ---- the lattice of distinct units


def edges(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The columns of ``units``, (s, e) and the piece's columns: all pieces in each unit, and its other single
    characters with a null id. ``units``: (unit, ...), distinct; the result keeps their partitioning."""
    starts = units.withColumn("s", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1)))
    spans = starts.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("unit") - F.col("s")))))
    found = spans.withColumn("sub", F.substring("unit", F.col("s") + 1, F.col("len"))).join(F.broadcast(pieces), F.col("sub") == F.col("piece"), "left")
    return found.filter(F.col("id").isNotNull() | (F.col("len") == 1)).select(*units.columns, "s", (F.col("s") + F.col("len")).alias("e"), "id", "score", "rank", "late")


def _first(items: Column, keep) -> Column:
    return F.get(F.filter(items, keep), F.lit(0))


def _merge_fold(steps: Column, items: Column, late: Column, start: Column, fits, apply, earlier) -> tuple[Column, Column]:
    """(struct of the boundaries after one pass over ``items`` by rank and place, and whether this is final; the
    boundaries by always taking the best item that fits). late: the items that may fit only after a later one."""

    def once(acc: Column, x: Column) -> Column:
        now = apply(acc["at"], x)
        fine = acc["fine"] & ~F.exists(late, lambda f: earlier(f, x) & fits(now, f))
        return F.when(fits(acc["at"], x), F.struct(now.alias("at"), fine.alias("fine"))).otherwise(acc)

    def again(acc: Column, _: Column) -> Column:
        best = _first(items, lambda x: fits(acc, x))
        return F.when(best.isNotNull(), apply(acc, best)).otherwise(acc)

    return F.aggregate(items, F.struct(start.alias("at"), F.lit(True).alias("fine")), once), F.aggregate(steps, start, again)


def _shift(x: Column | int, n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(x).cast("long") if isinstance(x, int) else x, n)


#: Fields of an edge of a short unit in one number, that sorts by rank, then place: rank, s, e, late, id + 1.
_ID_BITS, _POINT_BITS = 21, 6


def _pack(rank: Column, s: Column, e: Column, late: Column, id_: Column) -> Column:
    out = F.coalesce(rank, F.lit(0)).cast("long")
    for value, bits in ((s, _POINT_BITS), (e, _POINT_BITS), (F.coalesce(late.cast("int"), F.lit(0)), 1), (F.coalesce(id_ + 1, F.lit(0)), _ID_BITS)):
        out = out * F.lit(1 << bits).cast("long") + value
    return out


def _start_of(x: Column) -> Column:
    return F.shiftright(x, _POINT_BITS + 1 + _ID_BITS).bitwiseAND(F.lit((1 << _POINT_BITS) - 1)).cast("int")


def _end_of(x: Column) -> Column:
    return F.shiftright(x, 1 + _ID_BITS).bitwiseAND(F.lit((1 << _POINT_BITS) - 1)).cast("int")


def encode_units(units: DataFrame, pieces: Pieces, kind: str = "bpe") -> DataFrame:
    """The columns of ``units`` and ids array<int>. ``units``: (unit, ...), distinct and not empty. It is encoded in a
    session whose settings are its own."""
    if kind not in ("bpe", "unigram"):
        raise ValueError(f"unknown kind {kind}")
    spark, keys = units.sparkSession, units.columns
    n = units.count()
    # a partition's units are few: no need to sort their edges
    own = common.session_with(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(4 * PARTITION_UNITS)})
    units = common.in_session(units, own)
    dealt = units.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PARTITION_UNITS + 1), "unit")
    size = F.char_length("unit")
    found = edges(dealt.filter(size <= LONG), pieces.table(own), pieces.longest)
    if kind == "unigram":
        out = _viterbi(found, pieces, keys)
    else:
        out = _encode_short(found.filter(size <= SHORT), pieces, keys).unionByName(_encode_long(found.filter(size > SHORT), pieces, keys))
    at = keys.index("unit")

    def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = [pieces.segment(u, kind) for u in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*keys, "ids"])

    longest = units.filter(size > LONG).mapInArrow(segments, units.withColumn("ids", F.array().cast("array<int>")).schema)
    return common.materialize(out.unionByName(longest), "units", spark, release=True)


def _encode_short(found: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """Boundaries are the bits of a number."""
    found = found.groupBy(*keys).agg(F.array_sort(F.collect_list(_pack(F.col("rank"), F.col("s"), F.col("e"), F.col("late"), F.col("id")))).alias("all"))

    def item(x: Column) -> Column:
        ends = _shift(1, _start_of(x)).bitwiseOR(_shift(1, _end_of(x)))
        return F.struct(x.alias("x"), ends.alias("ends"), (_shift(1, _end_of(x)) - _shift(2, _start_of(x))).alias("mid"))

    several = F.filter("all", lambda x: _end_of(x) - _start_of(x) > 1)
    found = found.withColumn("items", F.transform(several, item)).withColumn("start", _shift(1, F.char_length("unit") + 1) - 1)
    found = found.withColumn("late", F.filter("items", lambda i: F.shiftright(i["x"], _ID_BITS).bitwiseAND(F.lit(1)) == 1))
    fits = lambda at, i: (at.bitwiseAND(i["ends"]) == i["ends"]) & (F.bit_count(at.bitwiseAND(i["mid"])) == 1)
    cut = lambda at, i: at.bitwiseXOR(at.bitwiseAND(i["mid"]))
    swift, slow = _merge_fold(F.sequence(F.lit(1), F.char_length("unit")), F.col("items"), F.col("late"), F.col("start"), fits, cut, lambda f, x: f["x"] < x["x"])
    found = found.withColumn("swift", swift).withColumn("at", F.when(F.col("swift.fine"), F.col("swift.at")).otherwise(slow))
    on = lambda i: F.col("at").bitwiseAND(_shift(1, i)) != 0
    inner = lambda x: F.col("at").bitwiseAND(_shift(1, _end_of(x)) - _shift(2, _start_of(x))) == 0
    kept = F.filter("all", lambda x: on(_start_of(x)) & on(_end_of(x)) & inner(x))
    out = F.transform(kept, lambda x: F.struct(_start_of(x).alias("s"), (x.bitwiseAND(F.lit((1 << _ID_BITS) - 1)) - 1).cast("int").alias("id")))
    found = found.withColumn("out", F.array_sort(out))
    return found.select(*keys, _ids(F.col("out"), pieces).alias("ids"))


def _encode_long(found: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """Boundaries are the ones of a string."""
    found = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "s", "e", "late", "id"))).alias("all"))
    found = found.withColumn("items", F.filter("all", lambda x: x["e"] - x["s"] > 1)).withColumn("start", F.repeat(F.lit("1"), F.char_length("unit") + 1))
    found = found.withColumn("late", F.filter("items", lambda x: x["late"]))
    point = lambda at, i: F.substring(at, i + 1, F.lit(1)) == "1"
    ones = lambda at, x: F.char_length(F.replace(F.substring(at, x["s"] + 2, x["e"] - x["s"] - 1), F.lit("0"), F.lit("")))
    fits = lambda at, x: point(at, x["s"]) & point(at, x["e"]) & (ones(at, x) == 1)
    cut = lambda at, x: F.overlay(at, F.repeat(F.lit("0"), x["e"] - x["s"] - 1), x["s"] + 2)
    earlier = lambda f, x: F.struct(f["rank"], f["s"], f["e"]) < F.struct(x["rank"], x["s"], x["e"])
    swift, slow = _merge_fold(F.sequence(F.lit(1), F.char_length("unit")), F.col("items"), F.col("late"), F.col("start"), fits, cut, earlier)
    found = found.withColumn("swift", swift).withColumn("at", F.when(F.col("swift.fine"), F.col("swift.at")).otherwise(slow))
    kept = F.filter("all", lambda x: point(F.col("at"), x["s"]) & point(F.col("at"), x["e"]) & (ones(F.col("at"), x) == 0))
    out = F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.coalesce(x["id"], F.lit(-1)).alias("id"))))
    return found.withColumn("out", out).select(*keys, _ids(F.col("out"), pieces).alias("ids"))


def _ids(out: Column, pieces: Pieces) -> Column:
    """Ids of the segments ``out`` (s, id), in order; a character without a piece (id -1) becomes its UTF-8 bytes, or 0."""

    def spelt(s: Column) -> Column:
        code = F.hex(F.encode(F.substring("unit", s + 1, F.lit(1)), "UTF-8"))
        at = F.sequence(F.lit(1), F.length(code), F.lit(2))
        if pieces.first_byte < 0:
            return F.array(F.lit(0))
        return F.transform(at, lambda i: (F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + F.lit(pieces.first_byte)))

    plain = F.transform(out, lambda x: x["id"])
    full = F.flatten(F.transform(out, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(spelt(x["s"]))))
    return F.when(F.forall(plain, lambda i: i >= 0), plain).otherwise(full)


def _viterbi(found: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """Of paths with equal scores, the one whose last piece is longest. Characters without a piece cost 10 more than
    the lowest score."""
    low = min(pieces.score, default=0.0) - 10
    item = F.struct("e", "s", F.coalesce("score", F.lit(low)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    units = found.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def best(acc: Column, i: Column) -> Column:
        ways = F.transform(
            F.filter("all", lambda x: x["e"] == i),
            lambda x: F.struct((F.get(acc, x["s"])["score"] + x["score"]).alias("score"), (i - x["s"]).alias("n"), x["s"].alias("s"), x["id"].alias("id")),
        )
        return F.concat(acc, F.array(F.array_max(ways)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(None).cast("int").alias("id")))
    units = units.withColumn("best", F.aggregate(F.sequence(F.lit(1), F.char_length("unit")), start, best))

    def back(acc: Column, _: Column) -> Column:
        here = F.get(F.col("best"), acc["at"])
        return F.when(acc["at"] > 0, F.struct(here["s"].alias("at"), F.concat(F.array(F.struct(here["s"].alias("s"), here["id"].alias("id"))), acc["out"]).alias("out"))).otherwise(acc)

    begin = F.struct(F.char_length("unit").alias("at"), F.array().cast("array<struct<s:int,id:int>>").alias("out"))
    units = units.withColumn("out", F.aggregate(F.sequence(F.lit(1), F.char_length("unit")), begin, back, lambda acc: acc["out"]))
    return units.select(*keys, _ids(F.col("out"), pieces).alias("ids"))


# ---- texts


def _count_units(path: str):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            both = pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")])
            held.clear()
            return both.rename_columns(["unit", "n"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(table.cast(pa.schema([("unit", pa.string()), ("n", pa.int64())])).to_batches(1 << 16))

        for batch in it:
            for parts, _ in pieces.chunks(batch.column(0).to_pylist(), _COUNT_CHARS):
                found = pieces.split(parts)[0].dictionary_encode()
                n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                held.append(pa.table({"unit": found.dictionary, "n": n}))
                if sum(map(len, held)) > _COUNTED_ROWS:
                    held.append(summed())
                    if len(held[0]) > _COUNTED_ROWS // 2:
                        yield from out(held.pop())
        if held:
            yield from out(summed())
        common.release_memory()

    return batches


def _ragged(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Codes:
    """Ids of units: unit number k has ``lengths[k]`` of ``values``, from ``starts[k]`` on; ``fine``: they decode to it."""

    def __init__(self, units: pa.Array, ids: pa.Array, pieces: Pieces):
        self.units = units.cast(pa.large_string())
        offsets = ids.offsets.to_numpy()
        self.starts, self.lengths = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        self.values = ids.values.to_numpy(zero_copy_only=False).astype("<i4")
        raw = np.frombuffer(b"".join(pieces.raw), np.uint8)
        widths = np.array([len(x) for x in pieces.raw], np.int64)
        own = _ragged(self.starts, self.lengths, self.values)
        decoded = _ragged((np.cumsum(widths) - widths)[own], widths[own], raw).tobytes()
        ends = np.concatenate([[0], np.cumsum(widths[own])])[np.concatenate([[0], np.cumsum(self.lengths)])]
        raw_units = self.units.cast(pa.large_binary())
        fine = [[decoded[i:j] == u for i, j, u in zip(ends[k : k + _COMPARED].tolist(), ends[k + 1 : k + 1 + _COMPARED].tolist(), raw_units[k : k + _COMPARED].to_pylist())] for k in range(0, len(raw_units), _COMPARED)]
        self.fine = np.array([x for part in fine for x in part], bool)

    def find(self, units: pa.Array) -> np.ndarray:
        """The number of each unit, -1 for those that aren't here."""
        return pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64) if len(self.units) else np.full(len(units), -1)


class Head(Codes):
    """The frequent units. Texts are compressed against the most frequent of them."""

    def __init__(self, units: pa.Array, ids: pa.Array, pieces: Pieces):
        super().__init__(units, ids, pieces)
        primer = "".join(units[:_PRIMER_UNITS].to_pylist()[::-1]).replace(MARK, " ").encode("utf-8", "surrogatepass")  # what is near its end is cheapest
        primer = zstandard.ZstdCompressionDict(primer or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=primer, write_checksum=False)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=primer)


def _head(path: str, shared) -> Head:
    name, sent = shared
    if name not in _HEADS:
        _HEADS.clear()
        _HEADS[name] = Head(*sent.value, model(path))
        common.release_memory()
    return _HEADS[name]


def _other_units(path: str, shared):
    """(key, unit) of the units of each text that the head doesn't have."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, pieces = _head(path, shared), model(path)
        for batch in it:
            keys = batch.column(0).to_numpy()
            for parts, owners in pieces.chunks(batch.column(1).to_pylist()):
                units, part = pieces.split(parts)
                rare = np.flatnonzero(head.find(units) < 0)
                found = units.take(pa.array(rare)).dictionary_encode()
                pairs = np.unique((np.array(owners, np.int64)[part[rare]] << 32) | found.indices.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(keys[pairs >> 32]), found.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())], names=["key", "unit"])
        common.release_memory()

    return batches


def _pack_texts(path: str, shared):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _head(path, shared).packer.compress
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(pack, b.column(2).to_pylist()), pa.binary())], names=["key", "id", "packed"])

    return batches


def _assemble(path: str, shared):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, pieces = _head(path, shared), model(path)
        for batch in (whole.slice(k, BATCH_ROWS) for whole in it for k in range(0, whole.num_rows, BATCH_ROWS)):
            texts = [head.unpacker.decompress(x).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            own = Codes(batch.column(2).flatten(), batch.column(3).flatten(), pieces)  # of all texts here: a unit's ids are the same in each
            fine = np.concatenate([head.fine, own.fine])
            starts, lengths = np.concatenate([head.starts, own.starts + len(head.values)]), np.concatenate([head.lengths, own.lengths])
            values = np.concatenate([head.values, own.values])
            out, sizes, crcs, same = [], np.zeros(len(texts), np.int64), [0] * len(texts), np.ones(len(texts), bool)
            for parts, owners in pieces.chunks(texts):
                units, part = pieces.split(parts)
                at = head.find(units)
                rare = np.flatnonzero(at < 0)
                found = own.find(units.take(pa.array(rare)))
                if (found < 0).any():
                    raise KeyError(f"units without ids: {units.take(pa.array(rare[found < 0][:5])).to_pylist()}")
                at[rare] = found + len(head.starts)
                ids = _ragged(starts[at], lengths[at], values)
                n_ids = np.bincount(part, lengths[at], len(parts)).astype(np.int64)
                ends = np.cumsum(n_ids)
                for k in part[~fine[at]].tolist():
                    same[owners[k]] = False
                for k, owner in enumerate(owners):
                    crcs[owner] = zlib.crc32(ids[ends[k] - n_ids[k] : ends[k]].tobytes(), crcs[owner])
                np.add.at(sizes, owners, n_ids)
                out.append(ids)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([*out, np.zeros(0, "<i4")]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(sizes), pa.array(crcs, pa.int64()), pa.array(same)], names=["id", "ids", "n_pieces", "ids_crc32", "round_trip"])
        common.release_memory()

    return batches


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe", head: int = HEAD) -> DataFrame:
    """(id, ids array<int>, n_pieces, ids_crc32, round_trip) of each row of ``docs``.

    ids_crc32 is of the ids as little-endian 32-bit numbers; round_trip tells whether decoding gives the text again. A
    null text counts as empty and has no ids, as any empty text. Repeated rows and null ids are encoded like others,
    texts and words of any length are encoded whole, and other columns aren't read. ``path`` is the model's file on
    driver and executors. A model with a normaliser other than identity isn't supported. Empty table: empty result.
    """
    spark = docs.sparkSession
    pieces = model(path)
    slim = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    counted = slim.select("text").mapInArrow(_count_units(path), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = common.materialize(counted, "counts", release=True, settings=_BATCHES)
    coded_table = encode_units(counted, pieces, kind)
    coded = coded_table.select("unit", "n", F.col("ids").alias("code"))
    common.forget(counted)

    short = F.char_length("unit") <= HEAD_CHARS
    in_head = short & common.most_frequent(coded.filter(short), "n", head)
    top = coded.filter(in_head).toArrow().sort_by([("n", "descending"), ("unit", "ascending")])
    shared = (uuid.uuid4().hex, spark.sparkContext.broadcast((top.column("unit").combine_chunks(), top.column("code").combine_chunks())))

    keyed = slim.withColumn("key", F.xxhash64("id", "text"))
    others = keyed.select("key", "text").mapInArrow(_other_units(path, shared), "key long, unit string")
    rest = coded.filter(~in_head)
    own = common.spread_join(others, rest, "unit", "n", rest.agg(F.sum("n")).first()[0] or 0)
    own = own.groupBy("key").agg(F.collect_set(F.struct("unit", "code")).alias("own")).select(F.col("key").alias("own_key"), F.col("own.unit").alias("units"), F.col("own.code").alias("codes"))
    own = common.materialize(own, "own", release=True, settings=_BATCHES)
    common.forget(coded_table)
    packed = keyed.select("key", "id", F.col("text").cast("binary").alias("raw"))
    packed = packed.mapInArrow(_pack_texts(path, shared), packed.withColumnRenamed("raw", "packed").schema)
    both = packed.join(own, F.col("key") == F.col("own_key"), "left").select("id", "packed", "units", "codes")
    schema = slim.select("id", F.lit(None).cast("array<int>").alias("ids"), F.lit(0).cast("long").alias("n_pieces"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(True).alias("round_trip")).schema
    return both.mapInArrow(_assemble(path, shared), schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``df`` with the text of each row's ids; null ids give null."""
    rest = df.select(*[c for c in df.columns if c != out_col])
    schema = rest.withColumn(out_col, F.lit(None).cast("string")).schema
    place = rest.columns.index(ids_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for b in it:
            texts = [None if x is None else pieces.decode(x) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return rest.mapInArrow(batches, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir):
    return encode(common.documents(spark, sf_dir).select("doc_id", "text"), default_model())
