import hashlib
import re

from rcspark.llm import exact_dedup


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_against_brute_force(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    want = []
    for r in rows:
        ids = groups[normal(r.text)]
        low = min((i for i in ids if i is not None), default=None)
        want.append((r.doc_id, low, len(ids), r.doc_id == low, hashlib.sha256(normal(r.text).encode()).hexdigest()))
    got = exact_dedup.exact_groups(odd_docs)
    assert [c for c in odd_docs.columns if c not in ("group_size",)] == [c for c in got.columns if c in odd_docs.columns and c != "group_size"]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_and_many_salts(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(200)], "doc_id long, text string").repartition(7)
    for salts in (1, 3, 50):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, salts=salts).collect()}
        assert all(got[i] == ((1, 100) if i % 2 else (i, 1)) for i in range(200))
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_texts_that_share_a_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}
