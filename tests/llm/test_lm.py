import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rcspark.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, smoothing, head):
    """Base values and the unquantised model. Only ``head`` words are numbered; their counts are told apart in steps."""
    tokens = [WORD.findall(lower(t or "")) + [""] for _, t in rows]
    counts, pairs, before = Counter(), Counter(), Counter()
    for (i, _), w in zip(rows, tokens):
        if not held(i):
            counts.update(w)
            seq = [None, *w]
            pairs.update(zip(seq, seq[1:]))
            before.update(seq[:-1])
    n, v = sum(counts.values()), len(counts)
    p1 = lambda w: (counts[w] + 1) / (n + v + 1)
    numbered, levels = {""}, Counter(math.floor(math.log(c) * 64) for w, c in counts.items() if w and len(w.encode()) <= 64)
    for level in sorted(levels, reverse=True):
        if levels[level] > head:
            break
        head -= levels[level]
        numbered |= {w for w, c in counts.items() if math.floor(math.log(c) * 64) == level and len(w.encode()) <= 64}
    out = []
    for (i, _), w in zip(rows, tokens):
        base = sum(math.log10(p1(x)) for x in w)
        seq = [None, *w]
        share = lambda a, b: smoothing * p1(b) if b in numbered or not pairs[a, b] else 0.0
        score = sum(math.log10((pairs[a, b] + share(a, b)) / (before[a] + smoothing)) for a, b in zip(seq, seq[1:]))
        out.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, base, score))
    return out


def corpus():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)] + ["Wörd", "THE", "the", "😀"]
    rows = [(i, " ".join(words[j % len(words)] for j in rng.zipf(1.4, rng.integers(0, 40)))) for i in range(250)]
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "the " * 3000), (1003, "again"), (None, "no id the"), (1005, "unseen" * 30)]


@pytest.mark.parametrize("options", [{}, {"shard_pairs": 100, "block_pairs": 64}, {"head": 10, "shard_pairs": 300}, {"head": 0, "block_pairs": 7}])
def test_against_brute_force(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, lm.score(docs, **options).collect()), key=str)
    want = sorted(brute(rows, lm.SMOOTHING, options.get("head", 10**6)), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], abs=0.02 * w[2] + 0.02)  # 8 bits a probability


def test_probabilities_sum_to_one(spark):
    words, counts = [b"a", b"b", b"c"], np.array([5, 3, 1])
    head = lm.Head(words, counts, 9 + 6 + 4, 3 + 4 + 1, 4)  # 4 rare words with 6 tokens, and the end
    numbered = 10 ** head.log_p1(np.arange(4))
    assert numbered.sum() + (6 + 4 + 1) / (19 + 8 + 1) == pytest.approx(1)  # the rare words and the unseen
    assert (head.log_p1(np.array([4, 1 << 60])) == 0).all()


def test_a_context_is_spread_as_far_as_its_count_asks():
    head = lm.Head([b"a", b"b"], np.array([6000, 10]), 8000, 50, 100)
    words = np.arange(5000)
    assert len(set(head.shard(np.zeros(5000, np.int64), words, 1000, 1000).tolist())) == 28  # 4 * 6000 * 7 / 6 / 1000
    assert len(set(head.shard(np.full(5000, 1), words, 1000, 1000).tolist())) == len(set(head.shard(np.full(5000, 1 << 50), words, 1000, 1000).tolist())) == 1


def test_empty_and_all_held_out(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lm.score(docs.limit(0)).count() == 0
    only = docs.filter(lm.is_held_out("doc_id"))
    rows = lm.score(only).collect()
    assert rows and all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(2)
    follow = {i: rng.integers(0, 200, 3) for i in range(200)}
    rows = []
    for i in range(800):
        w = [int(rng.integers(200))]
        for _ in range(40):
            w.append(int(rng.choice(follow[w[-1]])))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").toPandas()
    assert out.score.sum() > 0.6 * out.base_score.sum()  # both are negative


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 61, 1000), rng.integers(0, 9, 1000).astype(np.int32), rng.random(1000).astype(np.float32)
    for a, b in zip(lm.unpack(lm.pack(*x), 3), x):
        assert (a == b).all() and a.dtype == b.dtype
    assert len(lm.unpack(lm.pack(np.zeros(0, np.int64)), 1)[0]) == 0


def test_a_worker_holds_few_texts_and_gives_memory_back(spark, monkeypatch):
    """What a worker is sent at once is bounded by this operator, not by the session (10,000 texts)."""
    seen = []
    real = lm.common.materialize
    monkeypatch.setattr(lm.common, "materialize", lambda df, name, *a, **k: seen.append((name, k.get("settings") or {})) or real(df, name, *a, **k))
    lm.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).collect()
    sizes = {name: int(s.get("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)) for name, s in seen}
    assert sizes["words"] <= 1000 and sizes["bigrams"] <= 1000
