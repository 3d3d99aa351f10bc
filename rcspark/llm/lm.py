"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is a bigram model over words with Dirichlet smoothing. It is learnt from all training texts and is never in one
place. A task cuts its texts into blocks of tokens and sends each distinct bigram of a block once, with how often
training texts have it, to the shard of its context; contexts that are too frequent for a shard are spread over several
by word as well, which the smoothing allows, as all it needs of a context is its count. So the commonest bigram of a
corpus is one row a block. A shard counts, writes its trie as memory-mapped levels to its task's own folder, looks each
bigram up in it and sends the values back to the block, where they meet the block's table of tokens and are summed by
text.

Words: the most frequent ones, at most ``head``, are numbered and broadcast with their counts (entries of bounded
size); the rest keep 62-bit hashes, and meet their exact counts in a join. With m the smoothing, c(v) how often v has a
successor and p(w) = (c(w) + 1) / (N + V + 1):

* a numbered word: p(w|v) = (c(v,w) + m p(w)) / (c(v) + m);
* any other, after a v that it follows in training: c(v,w) / (c(v) + m), without the share of p(w), which is below
  m (c(w) + 1) / N; else m p(w) / (c(v) + m). So all words back off to their own counts.
"""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .elias_fano import Trie

#: Parameters: numbered words and their longest length, smoothing, tokens of a shard and of a block.
HEAD = 300_000
HEAD_BYTES = 64
SMOOTHING = 8.0
SHARD_PAIRS = 1_500_000
BLOCK_PAIRS = 1_000_000
_COUNTER_WORDS = 200_000
#: Texts that a worker is sent at once.
_BATCHES = common.small_batches(1000)
_KEY_BITS = 33
#: Spark's seed of xxhash64, so that joins find the same hashes.
_SEED = 42

_HEADS: dict[str, "Head"] = {}


class Head(dict):
    """Numbers of the frequent words; others get the end's number plus one plus a hash."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, n_train: int):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.end = len(words)
        self.n, self.v, self.counts = n, v, np.append(counts, n_train)  # the end's count last
        self.base = np.log10((self.counts + 1) / (n + v + 1))

    def __missing__(self, word: bytes) -> int:
        return self.end + 1 + (xxhash.xxh64_intdigest(word, _SEED) >> 2)

    def context_counts(self, contexts: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Exact counts: of numbered contexts and of the beginning from all texts, of others as seen by their shard."""
        return np.where(contexts < self.end, self.counts[np.minimum(contexts, self.end)], np.where(contexts == self.end, self.counts[-1], seen))

    def log_p1(self, words: np.ndarray) -> np.ndarray:
        """Of numbered words; 0 for others, whose share is added when their counts are at hand."""
        return np.where(words <= self.end, self.base[np.minimum(words, self.end)], 0.0)

    def shard(self, contexts: np.ndarray, words: np.ndarray, n_shards: int, shard_pairs: int) -> np.ndarray:
        """A context's bigrams go to as many shards as it takes to have at most a quarter of a shard's tokens in each."""
        tokens = np.where(contexts <= self.end, self.counts[np.minimum(contexts, self.end)], 0) * 7 / 6  # with the held-out texts'
        salts = np.maximum(np.ceil(4 * tokens / shard_pairs), 1).astype(np.uint64)
        return (_mix(_mix(contexts) + _mix(words) % salts) % np.uint64(n_shards)).astype(np.int64)


def _head(shared) -> Head:
    """shared: a name and the broadcast; a Python worker builds its dictionary once."""
    name, sent = shared
    if name not in _HEADS:
        _HEADS.clear()
        _HEADS[name] = Head(*sent.value)
        common.release_memory()
    return _HEADS[name]


def is_held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 after division by 7; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for batch in it:
        for raw in batch.column(0):
            counts.update(raw.as_py().lower().split())
            if len(counts) >= _COUNTER_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                counts.clear()
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
    del counts
    common.release_memory()


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """Byte planes: the first bytes of all, then the second bytes, and so on; so that zeros meet."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, as byte planes."""
    head = len(columns[0]).to_bytes(8, "little") + b"".join(c.dtype.str.encode() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(_planes, columns)))


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(raw[:8], "little"), 8 + 3 * columns, []
    for k in range(columns):
        kind = raw[8 + 3 * k : 11 + 3 * k].decode()
        size = n * np.dtype(kind).itemsize
        out.append(_unplanes(raw[at : at + size], n, kind))
        at += size
    return out


_OUT = "kind byte, key long, shard long, place long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, word binary, times long, block binary"
#: Kinds of rows: texts, bigrams of a block, words of a text that aren't numbered, a block's tokens.
_TEXT, _BIGRAMS, _WORD, _TOKENS = range(4)


def _send(shared, n_shards: int, shard_pairs: int, block_pairs: int, arrow_id: pa.DataType):
    """Of each text its counts and the numbered words' share of the base score; of its other words how often each is
    there; of each block the distinct bigrams by shard, and the tokens: their bigrams' places in the block, those of one
    shard being adjacent, and how many are each text's. ``place``: the block's number in 31 bits, and the place of the
    first bigram in 32."""
    schema = pa.schema([
        ("kind", pa.int8()), ("key", pa.int64()), ("shard", pa.int64()), ("place", pa.int64()), ("doc_id", arrow_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base", pa.float64()), ("word", pa.binary()), ("times", pa.int64()), ("block", pa.binary()),
    ])

    def rows(kind: int, n: int, **columns) -> pa.RecordBatch:
        made = {"kind": pa.array(np.full(n, kind, np.int8))} | columns
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = _head(shared)
        number, end = head.__getitem__, head.end
        part, doc, number_of, before = TaskContext.get().partitionId() << _KEY_BITS, 0, 0, end  # the beginning has the end's number
        held: list[tuple[np.ndarray, int, bool]] = []
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal number_of, before, size
            lengths = np.array([len(x) for x, _, _ in held], np.int64)
            docs = pack(np.array([d for _, d, _ in held], np.int32), lengths.astype(np.int32))
            training = np.repeat([not out for _, _, out in held], lengths)
            tokens = np.concatenate([*(x for x, _, _ in held), [before]])
            held.clear()
            before = int(tokens[-2])
            codes, words = pd.factorize(tokens)  # arrays of a block are large: each goes as soon as it can
            del tokens
            pairs = np.append(codes[-1:], codes[:-2]).astype(np.int64)  # the token before each
            pairs *= len(words)
            pairs += codes[:-1]
            del codes
            bigram, distinct = pd.factorize(pairs)
            bigram = bigram.astype(np.int32)
            del pairs
            times = np.bincount(bigram[training], minlength=len(distinct)).astype(np.int32)
            del training
            context, word = words[distinct // len(words)], words[distinct % len(words)]
            del distinct
            shard = head.shard(context, word, n_shards, shard_pairs)
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            table = len(docs).to_bytes(8, "little") + docs + pack(rank[bigram])
            n_bigrams = len(order)
            del rank, bigram
            shard, context, word, times = shard[order], context[order], word[order], times[order]
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            packed = [pack(context[a:b], word[a:b], times[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            first = number_of << 32
            yield rows(_BIGRAMS, len(packed), key=pa.array(np.full(len(packed), part)), shard=pa.array(shard[cuts[:-1]]), place=pa.array(first | cuts[:-1]), block=pa.array(packed, pa.binary()))
            yield rows(_TOKENS, 1, key=pa.array([part]), place=pa.array([first]), times=pa.array([n_bigrams]), block=pa.array([table], pa.binary()))
            number_of, size = number_of + 1, 0

        for batch in it:
            info, rare = [], []
            for raw, out in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = raw.as_py().lower().split()
                ids = np.fromiter(map(number, words), np.int64, len(words))
                other = np.flatnonzero(ids > end)
                base = float(head.base[ids[ids < end]].sum() + head.base[end])
                info.append((part | doc, len(words) + 1, len(words) - len(other) + int(head.counts[end] > 0), base))
                if len(other):
                    rare += [(part | doc, w, n) for w, n in Counter([words[i] for i in other]).items()]
                ids = np.append(ids, end)
                while len(ids):  # a long text has parts in several blocks
                    now, ids = ids[: block_pairs - size], ids[block_pairs - size :]
                    held.append((now, doc, bool(out)))
                    size += len(now)
                    if size >= block_pairs:
                        yield from blocks()
                doc += 1
            keys, tokens, known, base = (pa.array(x) for x in zip(*info, strict=True)) if info else ([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())])
            yield rows(_TEXT, len(info), key=keys, doc_id=batch.column(0), held_out=batch.column(2), n_tokens=tokens, n_known=known, base=base)
            if rare:
                keys, words, times = zip(*rare, strict=True)
                yield rows(_WORD, len(rare), key=pa.array(keys), word=pa.array(words, pa.binary()), times=pa.array(times))
        if held:
            yield from blocks()
        common.release_memory()

    return batches


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct numbers, place of each number among them); hashes first, so only distinct ones are sorted."""
    codes, distinct = pd.factorize(x)
    order = np.argsort(distinct, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[codes]


def make_trie(head: Head, contexts: np.ndarray, words: np.ndarray, keys: np.ndarray, counts: np.ndarray, smoothing: float) -> Trie:
    """contexts, words: sorted ids; keys: context place * number of words + word place, sorted; counts: of training."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    c_at, w_at = np.divmod(keys, max(len(words), 1))
    total = head.context_counts(contexts, np.bincount(c_at, counts, len(contexts)))
    has = np.flatnonzero(total > 0)  # a context that is spread may have no successor here, but its back-off weight
    c_at, total = np.searchsorted(has, c_at), total[has] + smoothing
    share = np.where(words <= head.end, 10 ** head.log_p1(words), 0.0)
    p = (counts + smoothing * share[w_at]) / total[c_at]
    return Trie.build(contexts[has], words, c_at, w_at, np.log10(p), np.log10(smoothing / total))


def _score_shards(shared, smoothing: float):
    """Replaces the blocks of bigrams by their log-probabilities, followed by the places and hashes of those words that
    aren't numbered and back off; lets other rows pass. Rows come in order of their shard, the others' being -1."""

    def one_shard(blocks: list[bytes]) -> list[bytes]:
        head = _head(shared)
        found = [unpack(b, 3) for b in blocks]
        sizes = [len(c) for c, _, _ in found]
        contexts, c_at = _places(np.concatenate([c for c, _, _ in found]))
        words, w_at = _places(np.concatenate([w for _, w, _ in found]))
        times = np.concatenate([t for _, _, t in found])
        del found
        keys, at = _places(c_at * len(words) + w_at)
        counts = np.bincount(at, times, len(keys))
        del c_at, times
        trie = make_trie(head, contexts, words, keys, counts, smoothing)
        folder = Path(tempfile.mkdtemp(prefix="trie-"))
        try:
            trie.save(folder)
            del trie
            mapped = Trie.load(folder)
            score = mapped.score_places(contexts, words, *np.divmod(keys, len(words)), head.log_p1(words)).astype("<f4")[at]
            del mapped
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        open_ = (counts[at] == 0) & (words[w_at] > head.end)
        out, start = [], 0
        for n in sizes:
            i = np.flatnonzero(open_[start : start + n])
            scores = pack(score[start : start + n])
            out.append(len(scores).to_bytes(8, "little") + scores + pack(i.astype("<i4"), words[w_at[start + i]] - head.end - 1))
            start += n
        return out

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return all_.set_column(all_.schema.get_field_index("block"), "block", pa.array(one_shard(all_.column("block").to_pylist()), pa.binary()))

        for batch in it:
            shard = batch.column("shard").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)), len(shard))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("shard")[0].as_py() != shard[a]:
                    yield done()
                part = batch.slice(a, b - a)
                if shard[a] < 0:
                    yield part
                else:
                    held.append(part)
        if held:
            yield done()
        common.release_memory()

    return batches


def _both(block: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(block[:8], "little")
    return block[8 : 8 + n], block[8 + n :]


def _sum_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, score, hash, times) from blocks in order, in each the bigrams first: each text's sum in the block, and the
    hashes of its words that back off. Holds one block."""
    scores = hashes = None
    for batch in it:
        for part, kind, place, times, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == _BIGRAMS:
                found, open_ = _both(block)
                (value,), (i, word) = unpack(found, 1), unpack(open_, 2)
                first = place & 0xFFFFFFFF
                if scores is None:
                    scores, hashes = [], []
                scores.append((first, value))
                hashes.append((first + i.astype(np.int64), word))
                continue
            value = np.zeros(times)
            for first, v in scores or []:
                value[first : first + len(v)] = v
            docs, tokens = _both(block)
            (doc, lengths), (bigram,) = unpack(docs, 2), unpack(tokens, 1)
            starts = np.cumsum(lengths) - lengths
            sums = np.add.reduceat(value[bigram], starts)
            yield pa.RecordBatch.from_arrays([pa.array(part | doc.astype(np.int64)), pa.array(sums), pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64())], names=["key", "score", "hash", "times"])
            at = np.concatenate([x for x, _ in hashes or []] or [np.zeros(0, np.int64)])
            if len(at):
                word = np.full(times, -1)
                word[at] = np.concatenate([w for _, w in hashes])
                rows = np.flatnonzero(word[bigram] >= 0)
                owner = np.repeat(doc.astype(np.int64), lengths)[rows]
                pairs, n = np.unique(np.stack([owner, word[bigram[rows]]], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(part | pairs[:, 0]), pa.nulls(len(n), pa.float64()), pa.array(pairs[:, 1]), pa.array(n)], names=["key", "score", "hash", "times"])
            scores = hashes = None
    common.release_memory()


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, smoothing: float = SMOOTHING, shard_pairs: int = SHARD_PAIRS, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain) of each row of ``docs``; ``gain`` is the
    score less the base score, by token: high where the model has seen a text's word pairs, most of all if often.

    Null and empty texts have one token, the end. Rows with a null id are training rows. Repeated rows are texts of
    their own. Texts and words of any length are read whole; other columns aren't read. Without training texts all
    probabilities are those of unseen words. Empty table: empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).cast("binary").alias("raw"), is_held_out(id_col).alias("held_out"))
    words = slim.filter("NOT held_out").select("raw").mapInArrow(_count_words, "word binary, n long")
    words = common.materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "words", release=True, settings=_BATCHES)
    n_train = slim.filter("NOT held_out").count()
    n_words, v_words = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = (n_words or 0) + n_train, v_words + (n_train > 0)

    short = F.length("word") <= HEAD_BYTES
    in_head = short & common.most_frequent(words.filter(short), "n", head)
    top = words.filter(in_head).toArrow()
    order = np.argsort(-top.column("n").to_numpy(), kind="stable")
    sent_head = spark.sparkContext.broadcast((top.column("word").take(pa.array(order)).to_pylist(), top.column("n").to_numpy()[order], n, v, n_train))
    shared = (uuid.uuid4().hex, sent_head)

    n_shards = max(1, math.ceil(n * 7 / 6 / shard_pairs))
    id_type = slim.schema["doc_id"].dataType
    arrow_id = pa.int64() if id_type.typeName() == "long" else (pa.int32() if id_type.typeName() == "integer" else pa.string())
    if arrow_id == pa.string():
        slim = slim.withColumn("doc_id", F.col("doc_id").cast("string"))
    sent = slim.mapInArrow(_send(shared, n_shards, shard_pairs, block_pairs, arrow_id), _OUT.format(id={pa.int64(): "long", pa.int32(): "int"}.get(arrow_id, "string")))
    # other rows ride along, spread by their text or block; all are sent once and nothing is written before the shards have run
    target = F.when(F.col("kind") == _BIGRAMS, F.col("shard")).otherwise(F.pmod(F.xxhash64("key", "place"), F.lit(n_shards)))
    dealt = sent.repartition(n_shards, target).withColumn("shard", F.coalesce("shard", F.lit(-1).cast("long"))).sortWithinPartitions("shard")
    sent = common.materialize(dealt.mapInArrow(_score_shards(shared, smoothing), sent.schema), "bigrams", release=True, settings=_BATCHES)
    number = F.shiftright("place", 32)
    blocks = sent.filter(F.col("kind").isin(_BIGRAMS, _TOKENS)).select("key", "kind", "place", "times", "block")
    blocks = blocks.repartition("key", number).sortWithinPartitions("key", number, "kind")
    sums = common.materialize(blocks.mapInArrow(_sum_blocks, "key long, score double, hash long, times long"), "sums", release=True)

    open_ = sums.filter("hash IS NOT NULL").groupBy(F.col("key").alias("open_key"), "hash").agg(F.sum("times").alias("open_times"))
    total = F.lit(float(n + v + 1))
    rare = sent.filter(F.col("kind") == _WORD).select("key", "word", "times").join(words.filter(~in_head), "word", "left")
    rare = rare.withColumn("log_p1", F.log10((F.coalesce("n", F.lit(0)) + 1) / total)).withColumn("own_hash", F.shiftrightunsigned(F.xxhash64("word"), 2))
    rare = rare.join(open_, (F.col("key") == F.col("open_key")) & (F.col("own_hash") == F.col("hash")), "left")
    rare = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.col("log_p1")).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("open_times") * F.col("log_p1")).alias("rare_score"),
    )
    sums = sums.filter("score IS NOT NULL").groupBy("key").agg(F.sum("score").alias("sum"))
    info = sent.filter(F.col("kind") == _TEXT).select("key", "doc_id", "held_out", "n_tokens", "n_known", "base")
    out = info.join(sums, "key", "left").join(rare, "key", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("sum") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    ).withColumn("gain", (F.col("score") - F.col("base_score")) / F.col("n_tokens"))


def query(spark, sf_dir):
    return score(common.documents(spark, sf_dir).select("doc_id", "text"))
