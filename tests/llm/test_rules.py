import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from rcspark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    hit = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def texts():
    rng = np.random.default_rng(0)
    out = [None, "", " \n", "a\nb\na\n\n\n a\na", "\x1c\x85\xa0word two", "a b c d e " * 3, "a " * 9]
    for _ in range(200):
        out.append("".join(rng.choice(list("ab \n#|é")) for _ in range(rng.integers(0, 120))))
    return out


def test_base_columns_against_brute_force():
    for t in texts():
        assert rules.measure(t)[:5] == brute(t), repr(t)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.05), (49, 50, 0.5), (50, 50, 0.2), (200, 5000, 0.05)])
def test_binomial_tail(k, n, p):
    exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 1000 else None
    if exact is not None:
        assert rules.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    else:
        assert 0 < rules.binomial_tail(k, n, p) < 1e-2


def test_cutoffs_are_certified_and_mild():
    tried = {"a": (0.1, 0.2), "b": (0.5,)}
    rows = [([2, 0], False, h, 200) for h in (True, False)] + [([0, 0], True, h, 900) for h in (True, False)] + [([0, 1], True, h, 60) for h in (True, False)] + [([0, 1], False, h, 70) for h in (True, False)]
    counts = pd.DataFrame(rows, columns=["levels", "good", "holdout", "n"])
    assert rules.choose_cutoffs(counts, 4, rules.Risk(), tried) == {"a": 0.2}
    few = counts.assign(n=counts.n // 100 + 1)
    assert not rules.choose_cutoffs(few, 4, rules.Risk(), tried)


def test_a_stratum_keeps_its_good_documents(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    docs, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        text = " ".join((w + "###") if bad else w for w in rng.choice(words, 30))
        docs.append((i, text, "en" if i % 6 else "xx"))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas().set_index("doc_id")
    good = out.index % 4 != 0
    assert out.kept[good].mean() > 0.95
    assert out.kept[~good & (out.index % 6 != 0)].mean() < 0.05


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = rules.judge(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert rules.judge(odd_docs.limit(0), labels).count() == 0
    assert rules.judge(odd_docs, labels.limit(0)).count() == odd_docs.count()
    kept = rules.judge(odd_docs, labels, risk=rules.Risk(max_strata=0)).collect()  # the join without a broadcast
    assert sorted(map(str, kept)) == sorted(map(str, rows))


def test_stage_judges_rows_not_ids(spark, tmp_path):
    long = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(None, long(30, "a")), (None, "short"), (7, long(31, "b")), (7, "tiny"), ((1 << 53) + 1, long(12, "c"))]
    docs = spark.createDataFrame([(i, t, "en", 5, 0.5) for i, t in rows], "doc_id long, text string, lang string, n_words int, rejected_by double")
    spark.createDataFrame([(7, 1), (7, 0), (None, 1)], "doc_id long, quality long").write.parquet(f"file://{tmp_path}/labels.parquet")
    out = rules.stage(spark, docs, f"file://{tmp_path}")
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(str(rows[i]) for i in (0, 2, 4))
    assert all((r.n_words, r.rejected_by) == (5, 0.5) for r in out.collect())
