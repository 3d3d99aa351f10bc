import hashlib
import random
import re
import time

from rcspark.llm import secrets

KEY = "x9KdQ2vLr8TmZ4wYb7Nc"


def brute(text):
    found = []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans_against_brute_force():
    rng = random.Random(0)
    parts = ["password", "PassWord", "passwd", "ſecret", "secret", "token", "api_key", "apikey", "APIKEY", "=", ":", " ", '"', "'", "abcd", "12345678", "AKIA", "ABCDEFGH12345678", "é", "😀", "\n", "0123456789abcdef", ".", "-"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        base = [x for x in secrets.find(t) if x[2] != "novel"]
        assert secrets.joined(base) == brute(t), repr(t)


def test_novel_strings_in_sensitive_context():
    assert [k for *_, k in secrets.find(f"Authorization: Bearer {KEY} end")] == ["novel"]
    assert secrets.find(f"some plain words {KEY} end") == []
    assert secrets.find("the private configuration_variable_name_database_connection is set") == []
    repeated = f"{KEY} is repeated; private {KEY}"
    assert secrets.find(repeated) == []


def test_redaction_merges_overlaps():
    assert secrets.redacted("abcdefgh", [(1, 3, "hex"), (2, 5, "novel"), (6, 7, "hex")], "X") == "aXfXh"


def test_odd_rows(spark, odd_docs):
    odd_docs = odd_docs.filter("doc_id IS NULL OR doc_id < 11")
    rows = secrets.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" and r.digest == "x" for r in rows)
    docs = spark.createDataFrame([(1, f"token={KEY}"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.scan(docs, redact=True).collect()} == {1: "[SECRET]", 2: None, 3: ""}
    assert secrets.scan(docs.limit(0)).count() == 0


def test_long_random_strings_of_a_small_alphabet_are_novel():
    rng = random.Random(4)
    for letters, length in (("0123456789ABCDEF", 96), ("0123456789ABCDEF", 128), ("0123456789abcdefABCDEF", 128), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 256)):
        for _ in range(20):
            key = "".join(rng.choice(letters) for _ in range(length))
            assert [k for *_, k in secrets.find(f"private key {key} end")] == ["novel"]
    assert secrets.find("private key " + "AB12" * 32) == []


def test_secrets_shown_twice_are_reported_each_time():
    text = f"private key {KEY} and again, bearer {KEY} end"
    assert [text[s:e] for s, e, _ in secrets.find(text)] == [KEY, KEY]


def test_far_candidates_and_many_base_spans():
    value = "kJ8sQ2mZx9TfW4bNc7RvLp3Yd6Hg"
    for gap in (1, 18, 42, 47):
        assert secrets.joined(secrets.find("private " + " " * (gap - 1) + value)).startswith(f"novel:{7 + gap}:")
    assert secrets.find("private" + " " * 49 + value) == []
    began = time.perf_counter()
    assert len(secrets.find("secret=abcdefgh1 " * 20_000)) == 20_000
    assert time.perf_counter() - began < 5
