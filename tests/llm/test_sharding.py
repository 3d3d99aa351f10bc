import zlib
from collections import Counter

import pytest

from rcspark.llm import sharding


def store(spark, tmp_path, **kw):
    return sharding.Store(spark, f"file://{tmp_path}/store", **{"target_bytes": 40_000, "tier_bytes": 1000, **kw})


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_arrivals_are_merged_and_nothing_is_lost(spark, tmp_path, odd_docs):
    s = store(spark, tmp_path)
    docs = odd_docs.unionByName(spark.range(400).selectExpr("id AS doc_id", "repeat(uuid(), 20) AS text", "'en' lang", "'s' source", "0L n_chars", "'d' digest", "'r' spans", "1 group_size"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    from pyspark.sql import functions as F

    v = s.append_arrivals(docs.repartition(6).withColumn("arrival", F.pmod(F.hash("doc_id"), F.lit(3))), "arrival")
    assert v == 3 and s.versions() == [1, 2, 3]
    before = s.manifest().count()
    v2 = s.compact()
    assert v2 > v and s.manifest().count() < before
    assert rows_of(s.read().select(*docs.columns)) == rows_of(docs)
    assert rows_of(s.read(3).select(*docs.columns)) == rows_of(docs)  # the old version is still there
    assert s.compact() == v2  # nothing is left to merge
    assert s.append(docs.limit(3)) == v2 + 1
    gone = s.vacuum()
    assert gone > 0 and s.versions() == [v2 + 1] and s.read().count() == docs.count() + 3


def test_runs_are_of_one_tier(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = [(f"p{i}", 10, size, 0 if size < 4000 else 1, 1) for i, size in enumerate([900, 950, 1000, 8000, 8100, 30000])]
    s.commit(spark.createDataFrame(rows, sharding.MANIFEST), 1)
    runs = {}
    for r in s.plan(1).collect():
        runs.setdefault(r.run, set()).add(r.path)
    assert sorted(map(sorted, runs.values())) == [["p0", "p1", "p2"], ["p3", "p4"]]


def test_a_version_is_committed_once(spark, tmp_path):
    s = store(spark, tmp_path)
    empty = spark.createDataFrame([], sharding.MANIFEST)
    s.commit(empty, 1)
    with pytest.raises(sharding.Conflict):
        s.commit(empty, 1)
    assert s.versions() == [1]


def test_empty_store(spark, tmp_path, odd_docs):
    s = store(spark, tmp_path)
    assert s.read() is None and s.compact() == 0
    s.append(odd_docs.limit(0))
    assert s.compact() == s.version()


def texts(spark, first, n):
    return spark.range(first, first + n).selectExpr("id AS doc_id", "concat('text ', id) AS text", "id % 3 AS run", "'p' AS path")


def test_beaten_writers_commit_on_top(spark, tmp_path):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    commit, calls = s.commit, []

    def late(shards, version):
        if not calls:
            calls.append(other.append(texts(spark, 100, 5)))
        return commit(shards, version)

    s.commit = late
    assert s.append(texts(spark, 0, 5)) == 2 and calls == [1]
    assert rows_of(s.read()) == rows_of(texts(spark, 0, 5).union(texts(spark, 100, 5)))
    calls.clear()
    s.commit = lambda shards, version: commit(shards, version) if calls else (calls.append(other.compact()), commit(shards, version))[1]
    s.compact()  # the other has merged the same runs
    assert rows_of(s.read()) == rows_of(texts(spark, 0, 5).union(texts(spark, 100, 5)))
    assert s.manifest().count() < 4


def test_a_path_with_odd_characters(spark, tmp_path):
    s = sharding.Store(spark, f"file://{tmp_path}/a b+c%20d/store", target_bytes=40_000, tier_bytes=1000)
    for i in range(3):
        s.append(texts(spark, 10 * i, 4))
    s.compact()
    assert s.manifest().count() == 1 and s.read().count() == 12
    assert s.vacuum() > 0 and s.read().count() == 12


def test_many_shards_are_read_without_a_list(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.append(texts(spark, 0, 10).repartition(4))
    s.append(texts(spark, 10, 10).repartition(3))
    want = rows_of(s.read())
    monkeypatch.setattr(sharding, "MAX_FILES", 2)
    assert rows_of(s.read()) == want and rows_of(s.read(1)) == rows_of(texts(spark, 0, 10))


def test_query_columns(spark, tmp_path):
    rows = [(1, "a"), (2, None), (2, "é" * 5000), (None, ""), (1, "a")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, arrival string")
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    out = sharding.query(spark, f"file://{tmp_path}/sf")
    assert out.columns == ["doc_id", "text_crc32", "shard", "tier", "shard_rows", "version"]
    got = out.collect()
    assert sorted(str((r.doc_id, r.text_crc32)) for r in got) == sorted(str((i, zlib.crc32((t or "").encode()))) for i, t in rows)
    sizes = Counter(r.shard for r in got)
    assert all(sizes[r.shard] == r.shard_rows for r in got) and len({r.version for r in got}) == 1
