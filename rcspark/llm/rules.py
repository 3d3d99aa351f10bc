"""Quality rules with risk-controlled thresholds.

Each rule compares one feature of a text with a cutoff, and a document is rejected if any rule rejects it. Cutoffs
aren't chosen by hand. In each stratum (language) one half of the labelled documents, by hash of the id, proposes a
path of ever stricter settings: each step lowers the cutoff of one rule, the one that rejects most further bad
documents for the fewest good ones. The other half is the holdout. It tests the settings along the path in order: a
setting is certified if the exact (Clopper-Pearson) upper confidence bound of the share of good documents that it
rejects is at most ``max_false_rejection``, and the first that isn't ends the path. Testing in a fixed order needs no
correction within a stratum; between strata the level is divided by their number (Bonferroni). So with probability
``1 - delta`` no stratum loses more than ``max_false_rejection`` of its good documents to the rules. A stratum with
too few labels for that keeps all rules off.

The upper bound at level a is at most e exactly if P(Binomial(n, e) <= k) <= a, so no quantile has to be inverted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: feature name -> cutoffs; a document is rejected where the feature exceeds the cutoff. Parameters.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "dup_line_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2),
    "upper_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "bang_share": (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2),
    "digit_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "long_words": (12.0, 14.0, 16.0, 20.0, 25.0, 30.0, 40.0, 60.0),
}


@dataclass(frozen=True)
class Risk:
    """max_false_rejection: the share of a stratum's good documents that all rules together may reject;
    delta: the probability that any stratum exceeds it; price: bad documents that a step must reject for each good
    one; max_strata: with more, the cutoffs are joined by shuffle instead of being broadcast."""

    max_false_rejection: float = 0.05
    delta: float = 0.05
    price: float = 10.0
    max_strata: int = 10_000


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that is found twice or more. Exact: windows are ranked by
    their words, never by hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    code, have = ids, 1
    while have < window:  # rank runs of 2, 4, ... words, the last step overlaps
        step = min(have, window - have)
        head, tail = code[: len(code) - step], code[step:]
        _, code = np.unique(head * (int(tail.max()) + 1) + tail, return_inverse=True)
        have += step
    counts = np.bincount(code)
    starts = np.flatnonzero(counts[code] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure(text: str | None) -> tuple[int, int, int, int, int, int, int, int]:
    """The five base columns, then upper-case letters A-Z, exclamation marks and digits."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    return (len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), upper, raw.count(b"!"), digits)


_MEASURED = [*BASE_COLUMNS, "n_upper", "n_bangs", "n_digits"]


def features(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs``, with the base columns and the rules' features, all from whole texts. Names in
    ``keep`` must not be among those."""
    slim = docs.select(*keep, common.text_or_empty(text_col).cast("binary").alias("rules_text"))
    out = slim.select(*keep).schema
    for c in _MEASURED:
        out = out.add(c, "long")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [measure(str(x.as_py(), "utf-8", "replace")) for x in b.column(len(keep))]
            found = np.array(rows, np.int64).reshape(b.num_rows, len(_MEASURED))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, found.T)], names=out.names)

    return slim.mapInArrow(batches, out).withColumns(shares())


def shares() -> dict:
    def share(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "bang_share": share("n_bangs", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "long_words": share("word_chars", "n_words"),
    }


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly in logs."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1)
    logs = np.cumsum(np.log(np.concatenate([[1.0], (n - i[:-1]) / i[1:]])) if k else np.zeros(1))
    logs = logs + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def propose(levels: np.ndarray, good: np.ndarray, n: np.ndarray, n_cutoffs: list[int], price: float) -> list[list[int]]:
    """The path: from each setting to the next, one rule's cutoff index falls. A setting rejects the rows with a level
    above the index in any rule; an index of n_cutoffs is off. Ties go to the earlier rule, then the milder cutoff."""
    at, path = list(n_cutoffs), []
    gone = np.zeros(len(levels), bool)
    while True:
        best = (0.0, None)
        for r in range(len(at)):
            for c in range(at[r] - 1, -1, -1):
                more = (levels[:, r] > c) & ~gone
                gain = float(n[more & ~good].sum()) - price * float(n[more & good].sum())
                if gain > best[0]:
                    best = (gain, (r, c))
        if best[1] is None:
            return path
        r, c = best[1]
        at[r] = c
        gone |= levels[:, r] > c
        path.append(list(at))


def certify(path: list[list[int]], levels: np.ndarray, good: np.ndarray, n: np.ndarray, bound: float, alpha: float) -> list[int] | None:
    """The last setting before the first that the holdout doesn't certify."""
    held, total = None, int(n[good].sum())
    for setting in path:
        rejected = (levels > np.array(setting)).any(1)
        if binomial_tail(int(n[rejected & good].sum()), total, bound) > alpha:
            break
        held = setting
    return held


def choose_cutoffs(counts: pd.DataFrame, n_strata: int, risk: Risk, rules: dict[str, tuple[float, ...]]) -> dict[str, float] | None:
    """counts, of one stratum: (levels, good, holdout, n), levels being how many cutoffs of each rule are exceeded."""
    levels = np.array(counts["levels"].tolist(), np.int64).reshape(len(counts), len(rules))
    order = np.lexsort(levels.T)
    levels, good, holdout, n = levels[order], counts["good"].to_numpy(bool)[order], counts["holdout"].to_numpy(bool)[order], counts["n"].to_numpy(np.int64)[order]
    path = propose(levels[~holdout], good[~holdout], n[~holdout], [len(c) for c in rules.values()], risk.price)
    held = certify(path, levels[holdout], good[holdout], n[holdout], risk.max_false_rejection, risk.delta / max(n_strata, 1))
    return held and {r: c[i] for (r, c), i in zip(rules.items(), held, strict=True) if i < len(c)}


def thresholds(
    feats: DataFrame, labels: DataFrame, stratum_col: str, id_col: str = "doc_id", risk: Risk = Risk(), rules: dict | None = None
) -> DataFrame:
    """The cutoffs in force, one row per stratum that has any: (stratum, one nullable double ``cut_<rule>`` per rule).

    ``feats`` has the rules' features beside id and stratum; ``labels`` has (id, quality), 1 for good, and may repeat
    an id (each label then counts), lack ids or hold nulls (these labels are ignored). All labels are used. What a
    stratum's task gets is one row per combination of levels, not per document.
    """
    rules = rules or RULES
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("label_id"), (F.col("quality") > 0).alias("good")).agg(F.count(F.lit(1)).alias("marks"))
    labelled = feats.filter(~base_failed()).join(marks, F.col(id_col) == F.col("label_id"))
    levels = F.array(*[sum((F.col(rule) > F.lit(c)).cast("int") for c in cutoffs) for rule, cutoffs in rules.items()])
    counts = (
        labelled.select(F.col(stratum_col).cast("string").alias("stratum"), levels.alias("levels"), "good", "marks", (F.pmod(F.xxhash64(id_col), F.lit(2)) == 1).alias("holdout"))
        .groupBy("stratum", "levels", "good", "holdout")
        .agg(F.sum("marks").alias("n"))
    )
    counts = common.materialize(counts, "rules")
    n_strata = counts.select("stratum").distinct().count()

    def per_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
        found = choose_cutoffs(pdf, n_strata, risk, rules)
        if not found:
            return pd.DataFrame({"stratum": pd.Series([], dtype=object)} | {f"cut_{r}": pd.Series([], dtype=float) for r in rules})
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]]} | {f"cut_{r}": [found.get(r, np.nan)] for r in rules})

    wide = counts.groupBy("stratum").applyInPandas(per_stratum, "stratum string, " + ", ".join(f"cut_{r} double" for r in rules))
    return wide.select("stratum", *[F.nanvl(f"cut_{r}", F.lit(None).cast("double")).alias(f"cut_{r}") for r in rules])


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: Risk = Risk(),
    rules: dict | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, base columns, base_failed, rejected_by, kept) for each row of ``docs``.

    Each row is judged by its own text: repeated and null ids need no care. Null text: no words, so base_failed. A null
    stratum is a stratum of its own. With no labels no rule but the base is in force. Texts of any length are read
    whole. Names in ``keep`` that clash with the result's come first, under their own names. Empty table: empty result.

    The cutoffs come from a slim table of features; if ``keep`` has more columns (a text, for instance) the features
    are measured again beside them, so that whole rows are neither shuffled nor written.
    """
    rules = rules or RULES
    want = list(dict.fromkeys([id_col, stratum_col, *keep]))
    names = [f"kept_{i}" for i in range(len(want))]
    plain = docs.select(F.col(text_col).alias("rules_text"), *[F.col(c).alias(n) for c, n in zip(want, names, strict=True)])
    own_id, own_stratum = names[0], names[want.index(stratum_col)]
    feats = common.materialize(features(plain, "rules_text", names[:2]), "features")
    cuts = common.materialize(thresholds(feats, labels.withColumnRenamed(id_col, own_id), own_stratum, own_id, risk, rules), "cutoffs")
    stratum_col = own_stratum
    if len(names) > 2:
        feats = features(plain, "rules_text", names)
    on = feats[stratum_col].cast("string").eqNullSafe(F.col("stratum"))
    if cuts.count() <= risk.max_strata:
        joined = feats.join(F.broadcast(cuts), on, "left")
    else:  # one row per stratum is too much to broadcast: shuffle, hot strata apart
        sizes = feats.groupBy(F.col(stratum_col).cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("stratum_rows"))
        total = feats.count()
        table = cuts.join(sizes, cuts["stratum"].eqNullSafe(sizes["stratum"])).drop(sizes["stratum"])
        joined = common.lookup_join(feats.withColumn("stratum", F.col(stratum_col).cast("string")), table, ["stratum"], "stratum_rows", total)
    over = [F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in rules]
    out = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*over)))
    kept = {w: F.col(n).alias(w) for w, n in zip(want, names, strict=True)}
    return out.select(
        *[kept[c] for c in dict.fromkeys([id_col, *keep])], *BASE_COLUMNS, "base_failed", "rejected_by",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
    )


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


def stage(spark, docs, sf_dir):
    """Pipeline stage: drops the documents that the rules reject, each row by its own text. The cutoffs, a row per
    language, are broadcast; the documents themselves pass in one narrow step."""
    columns = [f"doc_{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, columns, strict=True))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", of["doc_id"])
    out = judge(docs.toDF(*columns), labels, of["doc_id"], of["text"], of["lang"], keep=columns).filter("kept")
    return out.select(*[F.col(c).alias(name) for name, c in of.items()])
