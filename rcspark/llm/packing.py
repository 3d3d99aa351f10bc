"""Packing of tokenised documents into sequences, online and in bounded space.

Each partition keeps a fixed number of open windows. A piece goes to the window it fits best; if it fits none and all
windows are open, the fullest window is emitted, topped up with the head of the piece, and the rest is placed again.
What is still open at a partition's end is merged: the leftovers of ``fan_in`` partitions at a time are placed by the
same rule, level by level, until one group is left; its last window is cut into sequences of a power of two. So
sequences need no padding, and no task holds more than fan_in * open_windows windows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
END_ID = 2
OPEN_WINDOWS = 16
FAN_IN = 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_STAGED = PIECES + ", leftover boolean, origin long, ids binary"

#: Word caches of this Python worker by tokenizer file; a full cache starts anew.
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Encodes by white-space separated chunks, each of them once while it is cached.

    Exact for tokenizers that lower-case, split at white space and between letters and other characters, and then
    merge: no token and no normalisation spans two chunks, or a word and the point or comma after it. Texts that may
    hold one of the tokenizer's added tokens are encoded whole.
    """

    def __init__(self, path: str, cache_size: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # chunks have lost their case: what looks like an added token isn't one
        self.cache_size = cache_size
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, chunks: set[bytes]) -> None:
        """Adds the ids of chunks to the cache."""
        cache, model = self.cache, self.tokenizer.model
        marked = [c for c in chunks if c[-1:] in (b".", b",") and len(c) > 1 and 97 <= c[-2] <= 122]
        chunks.difference_update(marked)
        chunks.update(c for c in {c[:-1] for c in marked} | {c[-1:] for c in marked} if c not in cache)
        rest = []
        for c in chunks:
            if c.isalpha():  # ASCII letters: nothing to normalise or split
                cache[c] = np.array([t.id for t in model.tokenize(c.decode())], "<u4").tobytes()
            else:
                rest.append(c)
        if rest:
            done = self.tokenizer.encode([c.decode("utf-8", "replace") for c in rest], is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(done.ids, "<u4"), np.array(done.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(len(rest)), "right")
            at = 0
            for c, end in zip(rest, ends, strict=True):
                cache[c] = ids[at:end].tobytes()
                at = end
        for c in marked:
            cache[c] = cache[c[:-1]] + cache[c[-1:]]

    def encode_all(self, texts: list[bytes], budget: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; about ``budget`` bytes are looked up at once."""
        at = 0
        while at < len(texts):
            chunks, size = [], 0
            while at < len(texts) and (not chunks or size < budget):
                low = texts[at].lower()
                chunks.append(at if any(t in low for t in self.added) else low.split())
                size += len(texts[at])
                at += 1
            if len(self.cache) > self.cache_size:
                self.cache.clear()
            new: set[bytes] = set()
            for c in chunks:
                if not isinstance(c, int):
                    new.update(c)
            new = new.difference(self.cache)
            if new:
                self._learn(new)
            get = self.cache.__getitem__
            for c in chunks:
                if isinstance(c, int):
                    ids = self.whole.encode(texts[c].decode("utf-8", "replace"), add_special_tokens=False).ids
                    yield np.array(ids, "<u4").tobytes()
                else:
                    yield b"".join(map(get, c))


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, capacity: int, open_windows: int, first_id: int, emit):
        self.capacity, self.open_windows, self.emit, self.next_id = capacity, open_windows, emit, first_id
        self.windows: list[list] = []  # [filled, pieces]

    def close(self, pieces: list) -> None:
        at = 0
        for piece in pieces:
            self.emit(piece, self.next_id, at)
            at += len(piece[3]) // 4
        self.next_id += 1

    def place(self, doc_id, start: int, doc_tokens: int, ids: bytes) -> None:
        whole = 4 * self.capacity
        while len(ids) >= whole:
            self.close([(doc_id, start, doc_tokens, ids[:whole])])
            start, ids = start + self.capacity, ids[whole:]
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.windows if w[0] + n <= self.capacity]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.windows) < self.open_windows:
                best = [0, []]
                self.windows.append(best)
            else:
                best = max(self.windows, key=lambda w: w[0])
                n = self.capacity - best[0]
            best[0] += n
            best[1].append((doc_id, start, doc_tokens, ids[: 4 * n]))
            if best[0] == self.capacity:
                self.windows = [w for w in self.windows if w is not best]
                self.close(best[1])
            start, ids = start + n, ids[4 * n :]

    def finish(self) -> None:
        """Fill windows one after the other with all that is open; cut the last into powers of two."""
        pieces = [p for w in self.windows for p in w[1]]
        self.windows, room, now = [], 0, []
        left = sum(len(p[3]) // 4 for p in pieces)
        for doc_id, start, doc_tokens, ids in pieces:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                now.append((doc_id, start, doc_tokens, ids[: 4 * n]))
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    self.close(now)
                    now = []


def _first_id(level: int, part: int) -> int:
    """Sequence numbers of a level and partition: 4 bits, 28 bits, and 31 for the sequences."""
    return (level << 59) | (part << 31)


def _row(piece: tuple, sequence: int, offset: int, with_ids: bool) -> tuple:
    doc_id, start, doc_tokens, ids = piece
    return (doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence, offset, False, None, ids if with_ids else None)


_NAMES = [x.split()[0] for x in _STAGED.split(", ")]
_ARROW = pa.schema([(n, {"leftover": pa.bool_(), "ids": pa.binary()}.get(n, pa.int64())) for n in _NAMES])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _open_rows(packer: Packer, origin: int) -> list[tuple]:
    return [(d, s, len(i) // 4, zlib.crc32(i), n, None, None, True, origin, i) for w in packer.windows for d, s, n, i in w[1]]


def _merger(level: int, final: bool, capacity: int, open_windows: int, with_ids: bool):
    """Packs the leftovers of one group of partitions."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["group"].iloc[0])
        rows: list[tuple] = []
        packer = Packer(capacity, open_windows, _first_id(level, group), lambda p, s, o: rows.append(_row(p, s, o, with_ids)))
        pdf = pdf.sort_values(["origin", "no_id", "doc_id", "start"], kind="stable")
        for d, no_id, s, n, i in zip(pdf.doc_id, pdf.no_id, pdf.start, pdf.doc_tokens, pdf.ids, strict=True):
            packer.place(None if no_id else int(d), int(s), int(n), bytes(i))
        if final:
            packer.finish()
        else:
            rows += _open_rows(packer, group)
        columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]  # sequence numbers with nulls beside them must not become floats
        return pd.DataFrame({n: pd.array(list(c), dtype=object if n in ("leftover", "ids") else "Int64") for n, c in zip(_NAMES, columns, strict=True)})

    return merge


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    open_windows: int = OPEN_WINDOWS,
    fan_in: int = FAN_IN,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the tokenizer file's path on the executors. Ids are those of its ``encode`` without special tokens;
    added tokens that a text spells out count as such, as they do there. ``end_id`` ends each document, so a null or
    empty text is one token. Each row is a document of its own, also if ids repeat or are null. Texts of any length
    are encoded whole and cut into sequences. Other columns aren't read. Empty table: empty result.

    A merge of leftovers reads at most ``fan_in * open_windows`` windows, whatever the table's size: about
    ``fan_in * open_windows * capacity`` ids. The last of them is one task.
    """
    end = np.array([end_id], "<u4").tobytes()
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).cast("binary").alias("raw"))

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        packer = Packer(capacity, open_windows, _first_id(0, part), lambda p, s, o: rows.append(_row(p, s, o, with_ids)))
        encode_all = word_tokenizer(tokenizer).encode_all
        for batch in it:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist()), strict=True):
                ids += end
                packer.place(doc_id, 0, len(ids) // 4, ids)
            yield _batch(rows)
            rows.clear()
        rows += _open_rows(packer, part)
        yield _batch(rows)

    staged = common.materialize(slim.mapInArrow(first, _STAGED), "packing")
    done = [staged.filter("NOT leftover")]
    level = 0
    while True:
        left = staged.filter("leftover")
        last = left.agg(F.max("origin")).first()[0]
        if last is None:
            break
        level += 1
        final = last < fan_in

        grouped = left.drop("sequence_id", "offset").withColumn("group", F.floor(F.col("origin") / fan_in).cast("long"))
        # null ids would make pandas turn all of them into floats
        grouped = grouped.withColumn("no_id", F.col("doc_id").isNull()).fillna(0, ["doc_id"])
        staged = common.materialize(grouped.groupBy("group").applyInPandas(_merger(level, final, capacity, open_windows, with_ids), _STAGED), "packing")
        done.append(staged.filter("NOT leftover"))
        if final:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    return out.select(*names)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack(common.documents(spark, sf_dir).select("doc_id", "text"), default_tokenizer())


def stage(spark, docs, sf_dir):
    """Last pipeline stage: the packed pieces of the documents that are left, each row's by itself; see ``pack``."""
    return pack(docs, default_tokenizer())
