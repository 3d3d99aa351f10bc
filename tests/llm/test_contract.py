"""Each opN query over a small folder of tables with odd rows: its columns, their types, and one row per document."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from rcspark.llm import queries, simhash

LONG, STRING, BOOLEAN, DOUBLE = "bigint", "string", "boolean", "double"
#: name -> the columns that come first, in any order. More may follow.
COLUMNS = {
    "op1_quality_classifier": {"doc_id": LONG, "posterior": DOUBLE, "kept": BOOLEAN},
    "op2_sharding": {"doc_id": LONG, "text_crc32": LONG, "shard": STRING, "shard_rows": LONG, "version": LONG},
    "op3_quality_rules": {"doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG, "base_failed": BOOLEAN, "kept": BOOLEAN},
    "op4_sentencepiece": {"doc_id": LONG, "ids": "array<int>", "n_pieces": LONG, "ids_crc32": LONG, "round_trip": BOOLEAN},
    "op5_packing": {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG},
    "op6_exact_dedup": {"doc_id": LONG, "keep_id": LONG, "group_size": LONG, "kept": BOOLEAN, "text_sha256": STRING},
    "op7_lm_scoring": {"doc_id": LONG, "held_out": BOOLEAN, "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": DOUBLE, "score": DOUBLE},
    "op8_secret_scan": {"doc_id": LONG, "n_assign": LONG, "n_access": LONG, "n_hex": LONG, "base_sha256": STRING, "spans": STRING},
    "op9_simhash": {"doc_id": LONG, "fingerprint": STRING, "component_id": LONG},
    "op10_pii": {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": STRING, "spans": STRING},
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(300)] + ["Été", "mail@host.example", "+1 (555) 010-0000", "secret=abcdefgh99"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([3, 30, 90]))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[1][1]), (None, text(20)), (7, text(15)), (103, "long" * 20_000)]
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = [(i, t, "en" if (i or 0) % 2 else "de", f"src{(i or 0) % 3}", len(t or ""), "x", 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, digest string, node int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, sf, name):
    folder, rows = sf
    out = queries.QUERIES[name](spark, folder)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got = out.collect()
    ids = Counter(r.doc_id for r in got)
    want = Counter(i for i, _ in rows)
    if name == "op5_packing":  # a row per piece
        assert set(ids) == set(want) and sum(r.length for r in got if r.doc_id == 103) == next(r.doc_tokens for r in got if r.doc_id == 103)
    else:
        assert ids == want


def test_a_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11)) and set(COLUMNS) == set(queries.QUERIES)


def test_fingerprints_against_a_plain_version():
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "İ", " ", "\n", "\x1c", "word ", "the the the "]) for _ in range(rng.randrange(40)))
        assert simhash.fingerprint(text.encode()) == plain(text), text


def test_op6_digest_is_of_the_normalised_text(spark, sf):
    folder, rows = sf
    text = dict(rows)
    for r in queries.QUERIES["op6_exact_dedup"](spark, folder).filter("doc_id > 90").collect():
        assert r.text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text[r.doc_id] or "").encode()).hexdigest()
