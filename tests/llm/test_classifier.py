import math

import numpy as np
from pyspark.sql import functions as F

from rcspark.llm import classifier


def corpus(spark, n=900):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        host = f"h{i % 7}" if i % 3 else "hot"
        bad = rng.random() < (0.6 if host == "h1" else 0.1)
        text = " ".join(w.upper() + "!!" if bad else w for w in rng.choice(words, 40))
        rows.append((i, text, host, "p" if i % 2 else None))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int"), {r[0]: "!!" not in r[1] for r in rows}


def test_good_texts_stay_and_bad_ones_go(spark):
    docs, labels, good = corpus(spark)
    out = {r.doc_id: r for r in classifier.classify(docs, labels, "host", "path").collect()}
    assert len(out) == len(good)
    assert np.mean([out[i].kept == g for i, g in good.items()]) > 0.99
    low = [r.site_rate for r in out.values() if r.host == "h1"]
    assert np.mean(low) < np.mean([r.site_rate for r in out.values() if r.host == "h2"])


def test_sparse_sites_lean_on_the_global_rate():
    few = classifier.prior_strength(0.8, 1000, 1000.0, 1000.0, 1000 * 0.16)
    spread = classifier.prior_strength(0.8, 50, 50_000.0, 50 * 1000.0**2, 50_000 * 0.04)
    assert few > 100 > spread  # no spread beyond chance against a real one
    assert classifier.prior_strength(0.8, 1, 10.0, 100.0, 0.0) == 10.0


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = classifier.classify(odd_docs, labels, "source", "lang").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.posterior <= 1 for r in rows)
    assert classifier.classify(odd_docs.limit(0), labels, "source", "lang").count() == 0
    none = classifier.classify(odd_docs, labels.limit(0), "source", "lang").collect()
    assert all(r.evidence == 0 for r in none)


def test_url_site(spark):
    df = spark.createDataFrame([("http://Blog.Ex.com:80/fr/825?x=/a",), ("https://u@m.ex.org",), ("nonsense",), (None,)], "url string")
    host, path = classifier.url_site(F.col("url"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [("blog.ex.com", "fr"), ("m.ex.org", ""), ("", ""), (None, None)]


def test_posteriors_against_plain_sums(spark):
    """Thousands of sparse sites: rates, strengths and posteriors worked out again, document by document."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(3000):
        host = f"h{int(rng.zipf(1.3)) % 1500}"
        bad = rng.random() < 0.3
        docs.append((i, " ".join(w + "!" if bad and rng.random() < 0.3 else w for w in rng.choice(words, 12)), host, f"p{i % 3}"))
        if i % 3 == 0:
            labels.append((i, int(not bad)))
    out = classifier.classify(spark.createDataFrame(docs, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int"), "host", "path").toPandas()
    label = dict(labels)
    known = out[out.doc_id.isin(label)]
    base = math.log(np.mean([label[i] for i in known.doc_id]) / (1 - np.mean([label[i] for i in known.doc_id])))
    own = {r.doc_id: label.get(r.doc_id, 1 / (1 + math.exp(-(r.evidence + base)))) for r in out.itertuples()}
    by_host, by_path = {}, {}
    for r in out.itertuples():
        by_host.setdefault(r.host, []).append(own[r.doc_id])
        by_path.setdefault((r.host, r.path), []).append(own[r.doc_id])
    rate = np.mean(list(own.values()))
    hosts = classifier.prior_strength(rate, len(by_host), len(own), sum(len(g) ** 2 for g in by_host.values()), sum(len(g) * (np.mean(g) - rate) ** 2 for g in by_host.values()))
    spread = sum(len(g) * (np.mean(g) - np.mean(by_host[h])) ** 2 for (h, _), g in by_path.items())
    paths = classifier.prior_strength(rate, len(by_path) - len(by_host) + 1, len(own), sum(len(g) ** 2 for g in by_path.values()), spread)
    assert len(by_host) > 500
    for r in out.itertuples():
        h, p, mine = by_host[r.host], by_path[r.host, r.path], own[r.doc_id]
        host_rate = (hosts * rate + sum(h) - mine) / (hosts + len(h) - 1)
        site = min(max((paths * host_rate + sum(p) - mine) / (paths + len(p) - 1), 1e-4), 1 - 1e-4)
        assert (r.n_host, r.n_path) == (len(h), len(p))
        assert abs(r.site_rate - site) < 1e-9
        assert abs(r.posterior - 1 / (1 + math.exp(-(math.log(site / (1 - site)) + r.evidence)))) < 1e-9
