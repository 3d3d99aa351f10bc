import itertools
import random

import pytest
import sentencepiece

from rcspark.llm import pieces

PARTS = ["the", "ing", "re", "ñ", "é", "😀", " ", "  ", "\n", "\t", "▁", "a", "b", "er", "in", "x", "0", "1", ".", ",", "\\}$", "▁▁", "__(", "ird", "not", "equ", "VID", "ито", "со", "Ａ", "\x00"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_ids_are_the_librarys(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(901, None), (902, ""), (903, "the" * 300), (904, " " * 100), (None, "x"), (903, "the" * 300)]
    sp = library()
    want = sorted(str((i, sp.encode(t or ""))) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for head in (0, 50, 100_000):
        got = pieces.encode(docs, pieces.default_model(), head=head).collect()
        assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
        assert sorted(str((r.doc_id, r.ids)) for r in got) == want


def test_units_are_where_no_piece_reaches():
    m = pieces.model(pieces.default_model())
    neighbours = {x for t in m.text for x in itertools.pairwise(t)}
    rng = random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        marked = pieces.MARK + t.replace(" ", pieces.MARK) if t else ""
        units = m.units(t)
        assert "".join(units) == marked
        assert [u[-1] + v[0] for u, v in itertools.pairwise(units)] == [x + y for x, y in itertools.pairwise(marked) if (x, y) not in neighbours]
        for size in (1, 5, 50):  # long texts are cut between units
            chunks = list(m.chunks([t, "", t], size))
            found = [(owners[k], u) for parts, owners in chunks for us, part in [m.split(parts)] for u, k in zip(us.to_pylist(), part)]
            assert found == [(i, u) for i in (0, 2) for u in units]


def test_long_units_are_the_librarys_at_any_length():
    m, sp = pieces.model(pieces.default_model()), library()
    rng = random.Random(8)
    for n in (2, 10, 300, 3000):
        t = "".join(rng.choice(["the", "ing", "re", "in", "er", "a", "b"]) for _ in range(n))
        assert [i for u in m.units(t) for i in m.segment(u, "bpe")] == sp.encode(t)
    t = "".join(rng.choice(["the", "ing", "re", "in"]) for _ in range(400_000))  # a word of a million characters
    (unit,) = m.units(t)
    assert m.decode(m.segment(unit, "bpe")) == t


def test_words_longer_than_any_fold(spark):
    rng = random.Random(9)
    sp = library()
    rows = [(i, "a " + "".join(rng.choice(["the", "ing", "re", "in", "é"]) for _ in range(n)) + " b") for i, n in enumerate([25, 40, 70, 150, 1000])]
    got = pieces.encode(spark.createDataFrame(rows * 2, "doc_id long, text string"), pieces.default_model(), head=3).collect()
    assert sorted(map(str, [(r.doc_id, r.ids) for r in got])) == sorted(str((i, sp.encode(t))) for i, t in rows * 2)


def test_decoding_inverts_encoding(spark):
    sp, m = library(), pieces.model(pieces.default_model())
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS[:10]) for _ in range(rng.randrange(30))) for _ in range(100)]
    df = spark.createDataFrame([(i, sp.encode(t)) for i, t in enumerate(texts)] + [(1000, None)], "i int, ids array<int>")
    got = {r.i: r.text for r in pieces.decode(df, pieces.default_model()).collect()}
    assert got == {**dict(enumerate(texts)), 1000: None}
    assert m.decode(sp.encode("a b")) == "a b"


def test_viterbi_against_brute_force(spark):
    rng = random.Random(6)
    table = {"a": -1.0, "b": -1.5, "c": -2.0, "ab": -1.75, "bc": -2.25, "abc": -3.0, "ca": -1.25, "aa": -2.5, "bca": -2.75}
    model = pieces.Pieces.of(list(table), list(range(1, 10)), list(table.values()), -1, ())
    units = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(150)]

    def best(u):
        found = []
        for cuts in itertools.product((0, 1), repeat=len(u) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(u)]
            segs = [u[a:b] for a, b in itertools.pairwise(at)]
            if all(s in table or len(s) == 1 for s in segs):
                found.append(sum(table.get(s, min(table.values()) - 10) for s in segs))
        return max(found)

    df = spark.createDataFrame([(u,) for u in sorted(set(units))], "unit string")
    ids = {v: k for k, v in zip(table, range(1, 10))}
    for r in pieces.encode_units(df, model, "unigram").collect():
        segs = [ids.get(i) for i in r.ids]
        assert r.ids == model.segment(r.unit, "unigram")
        score = sum(table[s] if s else min(table.values()) - 10 for s in segs)
        assert score == pytest.approx(best(r.unit))
        assert sum(len(s) if s else 1 for s in segs) == len(r.unit)


def test_odd_rows(spark, odd_docs):
    sp = library()
    want = sorted(str((r.doc_id, sp.encode(r.text or ""))) for r in odd_docs.collect())
    got = pieces.encode(odd_docs, pieces.default_model())
    assert sorted(str((r.doc_id, r.ids)) for r in got.collect()) == want
    assert pieces.encode(odd_docs.limit(0), pieces.default_model()).count() == 0


def test_working_arrays_do_not_grow_with_the_batch(tmp_path):
    """A chunk's arrays, several of four and eight bytes a character, were over 100 MB."""
    import tracemalloc

    own = pieces.model(pieces.default_model())
    texts = ["the quick brown fox " * 200] * 1500  # six million characters
    own.split([texts[0]])
    tracemalloc.start()
    for parts, _ in own.chunks(texts):
        own.split(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
