"""run() against a brute-force pipeline on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(spark, path):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(120)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # exact copies
    rows += [(200 + i, rows[i + 10][1].replace(" ", "\n", 3)) for i in range(5)]  # equal after normalising
    rows += [(300, "short one"), (301, None), (302, text(40) + " token=abcdefgh12345 " + text(40))]
    rows += [(400, " ".join([*rows[20][1].split()[:-1], "changed"]) * 1)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality long").write.parquet(f"{path}/labels.parquet")
    return dict(rows)


def test_stages_and_result(spark, tmp_path):
    path = f"file://{tmp_path}/sf"
    rows = corpus(spark, path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        left.append({r.doc_id: r.text for r in docs.collect()})
    rules, exact, near, secret = left
    assert set(rules) == set(rows) - {300, 301}
    assert set(exact) == set(rules) - {100, 101, 102, 103, 104, 200, 201, 202, 203, 204}
    assert set(exact) - set(near) <= {400}
    assert "abcdefgh12345" not in secret[302] and "[SECRET]" in secret[302]
    assert {i for i in near if near[i] != secret[i]} == {302}
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {p.doc_id for p in pieces} == set(near)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert all(sum(p.length for p in own) == own[0].doc_tokens for own in by_doc.values())
