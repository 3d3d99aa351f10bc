"""Quality classifier with hierarchical empirical Bayes.

A logistic model of text features gives each document's evidence, its log-likelihood ratio of good against bad. Sites
have two levels, host and path below it. Grouped aggregation sums the documents' expected goodness (their label where
they have one, else the classifier's probability) by path and host; a path's rate is shrunk toward its host's, a
host's toward the global rate. The strength of both priors is estimated from the spread of the rates (method of
moments), so sparse sites lean on their parents. A document's own contribution is left out of its site's rates. The
posterior log-odds are those of the site's rate plus the document's evidence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, rules

#: The classifier's inputs: the rules' features, and the logarithm of the number of words.
FEATURES = [*rules.RULES, "log_words"]
#: Labelled rows that fit the classifier, at most; chosen by hash. Counts of sites use all rows.
SAMPLE = 20_000
KEEP_FROM = 0.5
_EDGE = 1e-4


def url_site(url: Column) -> tuple[Column, Column]:
    """Host, without port or user, and first path segment of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised inputs: (mean, scale, weights, the intercept first)."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = _inputs((x - mean) / scale)
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2 * max(len(y), 1) / 100)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def prior_strength(rate: float, n_sites: float, n: float, n2: float, between: float) -> float:
    """Beta prior strength by moments. n, n2: sum of the sites' counts and of their squares; between: sum over sites
    of count * (rate of the site - rate)**2. At least 1, at most a million (no spread beyond chance)."""
    room = rate * (1 - rate)
    scale = n - n2 / max(n, 1)
    if n_sites < 2 or scale <= 0 or room <= 0:
        return 1e6 if room <= 0 else 10.0
    spread = (between - (n_sites - 1) * room) / scale  # of the true rates
    share = min(max(spread / room, 1e-6), 0.5)
    return (1 - share) / share


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host_col: str,
    path_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """(id, host, path, n_host, n_path, evidence, site_rate, posterior, kept) for each row of ``docs``.

    ``labels``: (id, quality), 1 for good; null labels and ids are ignored, an id's labels are averaged. Null hosts or
    paths are sites of their own. With labels of one kind only, evidence is 0. Null and empty texts are scored as such,
    texts of any length whole; an empty table gives an empty result. Repeated rows and ids count as often as they are
    there. Other columns aren't read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    feats = rules.features(docs, "text", ["id", "host", "path"]).withColumn("log_words", F.log1p("n_words"))
    feats = common.materialize(feats.select("id", "host", "path", *FEATURES), "quality")
    marks = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
    marks = marks.agg(F.avg((F.col("quality") > 0).cast("double")).alias("good"))
    labelled = feats.join(marks, F.col("id") == F.col("label_id"), "left").drop("label_id")
    labelled = common.materialize(labelled, "labelled")

    known = labelled.filter("good IS NOT NULL")
    n_known = known.count()
    share = min(1.0, 0.9 * sample / max(n_known, 1))
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)).select(*FEATURES, "good").limit(sample)
    rows = np.array([tuple(r) for r in picked.collect()], float).reshape(-1, len(FEATURES) + 1)
    rows = rows[np.lexsort(rows.T)] if len(rows) else rows
    x, y = rows[:, :-1], rows[:, -1]
    if len(y) and 0 < y.mean() < 1:
        mean, scale, w = fit_logistic(x, y)
        logit = F.lit(float(w[0]))
        for i, f in enumerate(FEATURES):
            logit = logit + F.lit(float(w[i + 1] / scale[i])) * (F.col(f) - F.lit(float(mean[i])))
        base = math.log(y.mean() / (1 - y.mean()))
        evidence = F.greatest(F.least(logit - F.lit(base), F.lit(30.0)), F.lit(-30.0))
    else:
        base, evidence = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), F.lit(0.0)

    scored = labelled.select("id", "host", "path", "good", evidence.alias("evidence"))
    scored = scored.withColumn("own", F.coalesce("good", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(base))))))
    paths = common.materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_path"), F.sum("own").alias("good_path")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("good_path").alias("good_host"))
    total = hosts.agg(F.count(F.lit(1)), F.sum("n_host"), F.sum("good_host"), F.sum(F.col("n_host").cast("double") ** 2)).first()
    n_hosts, n, good, n2 = (float(v or 0) for v in total)
    rate = min(max(good / n if n else 0.5, _EDGE), 1 - _EDGE)
    spread = hosts.agg(F.sum(F.col("n_host") * (F.col("good_host") / F.col("n_host") - rate) ** 2)).first()[0] or 0.0
    strength = prior_strength(rate, n_hosts, n, n2, spread)

    same_host = F.col("host").eqNullSafe(F.col("host_key"))
    sites = paths.join(hosts.withColumnRenamed("host", "host_key"), same_host).drop("host_key")
    sites = common.materialize(sites, "sites")
    below = sites.agg(
        F.count(F.lit(1)), F.sum("n_path"), F.sum(F.col("n_path").cast("double") ** 2),
        F.sum(F.col("n_path") * (F.col("good_path") / F.col("n_path") - F.col("good_host") / F.col("n_host")) ** 2),
    ).first()
    n_paths, m, m2, inner = (float(v or 0) for v in below)
    strength_path = prior_strength(rate, n_paths - n_hosts + 1, m, m2, inner)

    joined = common.lookup_join(scored, sites.withColumn("rows", F.col("n_path")), ["host", "path"], "rows", int(n))
    host_rate = (F.lit(strength * rate) + F.col("good_host") - F.col("own")) / (F.lit(strength - 1) + F.col("n_host"))
    site_rate = (F.lit(strength_path) * host_rate + F.col("good_path") - F.col("own")) / (F.lit(strength_path - 1) + F.col("n_path"))
    site_rate = F.greatest(F.least(site_rate, F.lit(1 - _EDGE)), F.lit(_EDGE))
    posterior = 1 / (1 + F.exp(-(F.log(F.col("site_rate") / (1 - F.col("site_rate"))) + F.col("evidence"))))
    out = joined.withColumn("site_rate", site_rate).withColumn("posterior", posterior)
    return out.select(
        F.col("id").alias(id_col), "host", "path", "n_host", "n_path", "evidence", "site_rate", "posterior", (F.col("posterior") >= F.lit(keep_from)).alias("kept")
    )


def query(spark, sf_dir):
    """Documents by source (host) and language section (path)."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "source", "lang")
    return out.withColumnsRenamed({"host": "source", "path": "section", "n_host": "n_source", "n_path": "n_section"})
