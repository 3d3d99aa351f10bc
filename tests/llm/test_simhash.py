import random

import numpy as np
import pytest

from rcspark.llm import simhash


def brute(fps, radius):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= radius:
                p, q = find(a), find(b)
                if p != q:
                    parent[p] = q
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def clustered(seed, n=400, flips=4):
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 8):
        base = rng.getrandbits(64)
        for _ in range(8):
            f = base
            for _ in range(rng.randrange(flips + 1)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    return sorted(out)


def found(spark, fps, radius, block):
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = simhash.components(simhash.links(df, len(fps), radius, block)).collect()
    groups = {}
    for node, root in roots:
        groups.setdefault(root, {root}).add(node)
    return {frozenset(x & (1 << 64) - 1 for x in g) for g in groups.values()}


@pytest.mark.parametrize(("radius", "block"), [(3, 8192), (3, 4), (2, 8192), (4, 8192)])
def test_links_are_those_of_brute_force(spark, radius, block):
    fps = clustered(radius)
    assert found(spark, fps, radius, block) == brute(fps, radius)


def test_dense_group_and_probed_partitions(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)})
    assert found(spark, fps, 3, 8192) == brute(fps, 3)
    assert found(spark, fps, 3, 50) == brute(fps, 3)
    monkeypatch.setattr(simhash, "PARTITION_COUNTS", (2,))  # thresholds above zero
    assert found(spark, fps, 3, 8192) == brute(fps, 3)
    assert found(spark, fps, 3, 50) == brute(fps, 3)
    fps = clustered(9)
    assert found(spark, fps, 3, 3) == brute(fps, 3)


def test_thresholds_sum_and_prefer_cheap_partitions():
    parts = [list(range(32)), list(range(32, 64))]
    plan = simhash.allocate(parts, [1e12, 10.0], np.full(64, 0.9), 1000, 3)
    assert sum(t for _, t in plan.parts) - (2 - len(plan.parts)) == 3 - 2 + 1
    chosen = {b[0]: t for b, t in plan.parts}
    assert chosen.get(32, -1) > chosen.get(0, -1)


def test_texts_ids_and_extra_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "One two", "d"), (5, "one TWO", "e"), (None, "one two", "f"), (7, "x y z w", "g"), (7, "x y z w", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id, r.fingerprint == "0" * 16) for r in simhash.near_groups(docs).collect()}
    assert got == {(1, 1, True), (2, 1, True), (3, 1, True), (4, 4, False), (5, 4, False), (None, 4, False), (7, 7, False)}
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def shingles(t, words=5):
    w = t.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def test_groups_by_similarity_are_found_and_no_others(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 300]))]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            near = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((10 * g + k, " ".join(near)))
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (5002, "tiny"), (5002, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    text = dict((i, t or "") for i, t in rows if i is not None)
    sets = {i: shingles(t) for i, t in text.items()}
    want = brute_groups(list(text), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    expected = {i: min(g) for g in want for i in g if i != min(g)}
    assert got == expected | {None: 0, 5002: 5002}  # rows without an id, and rows that repeat one, follow as others do
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def brute_groups(ids, alike):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and alike(a, b):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    return [g for g in groups.values() if len(g) > 1]


def test_groups_by_similarity_are_complete(spark, monkeypatch):
    """Near copies at the edge of the similarity, of which many fingerprints are far apart, and a common passage."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for g in range(80):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 200]))] + passage
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 5):
            near = list(base)
            for _ in range(max(1, len(base) * 11 // 500)):  # about a tenth of the shingles
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((10 * g + k, " ".join(near)))
    assert similar_ids(spark, rows) == wanted(rows)
    monkeypatch.setattr(simhash, "OFTEN", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs, block=7).collect()} == wanted(rows)


def similar_ids(spark, rows):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def wanted(rows):
    sets = {i: shingles(t) for i, t in rows}
    return {i: min(g) for g in brute_groups(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8) for i in g if i != min(g)}


def test_large_group_whose_first_text_is_not_alike_to_all(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    rows = []
    for i in range(300):  # each has lost a passage of its own: alike to its neighbours, not to those further off
        rows.append((i, " ".join(base[:i] + base[i + 80 :])))
    assert similar_ids(spark, rows) == wanted(rows)


def test_texts_of_one_fingerprint_are_compared_with_each_other(spark):
    passage = [f"p{i}" for i in range(31)]
    tail = [f"a{i}" for i in range(25)]
    texts = [[*passage * 60, *[f"r{i}" for i in range(25)]], [*passage * 60, *tail], [*passage * 60, *tail[:-1], "b"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert len({simhash.fingerprint(t.encode()) for _, t in rows}) == 1
    assert similar_ids(spark, rows) == wanted(rows) == {2: 1}


def test_stage_groups_rows_not_ids(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(900)]) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (7, a), (7, b), (None, c), (None, c + " more"), (9, None), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left[:1] + left[1:3] == sorted([(1, a), (7, b), (8, "")], key=str)
    assert len(left) == 4 and left[3][0] is None and left[3][1] in (c, c + " more")
    assert simhash.stage(spark, docs.limit(0), "").count() == 0


def test_pairs_are_told_at_the_first_shared_shingle():
    pad = lambda rows: np.array([[*r, *[0] * (simhash.EARLY - len(r))] for r in rows], np.int64)
    a, b = pad([[5, 7, 9], [5, 7], [3], [], [1, 2]]), pad([[6, 7, 9], [7], [4], [], [2]])
    assert simhash.seen_before(np.array([7, 7, 8, 8, 9]), a, b).tolist() == [False, False, False, False, True]
    assert simhash.seen_before(np.array([9]), a[:1], b[:1]).tolist() == [True]


def test_links_of_fingerprints_join_texts(spark):
    rng = random.Random(3)
    fps = clustered(21, 160)
    rows = [(i, rng.choice(fps)) for i in range(300)]
    texts = spark.createDataFrame([(i, simhash.signed(f)) for i, f in rows], "node long, fp long")
    pairs = [(r.a, r.b) for r in simhash.fingerprint_links(texts).collect()]
    assert all(a < b for a, b in pairs)
    fp = dict(rows)
    near = lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3
    assert all(near(a, b) for a, b in pairs)
    joined = brute_groups(sorted(fp), lambda a, b: (a, b) in set(pairs))
    assert sorted(map(sorted, joined)) == sorted(map(sorted, brute_groups(sorted(fp), near)))


def test_similar_groups_come_from_fingerprints_first(spark, monkeypatch):
    """Near copies are joined by their fingerprints' links alone, without least hashes and without the exact way for the rest."""
    rng = random.Random(4)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(600)]
        rows += [(10 * g + k, " ".join(base[:-1] + [f"end{k}"])) for k in range(3)]
    close = [{10 * g + k for k in range(3)} for g in range(30)]
    fps = {i: simhash.fingerprint_of(simhash.shingle_hashes(t.encode())) for i, t in rows}
    want = {i: min(g) for g in brute_groups(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3) for i in g if i != min(g)}
    assert len(want) > 40 and all({i, j} <= next(c for c in close if i in c) for i, j in want.items())
    monkeypatch.setattr(simhash, "STARS", 0)
    monkeypatch.setattr(simhash, "overlapping", lambda *a: iter(()))
    assert similar_ids(spark, rows) == want
