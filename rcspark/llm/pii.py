"""Personal data by candidate gradient boosting, with DataFrame functions only.

Strict patterns give the base spans. Generators of high recall propose further, overlapping candidates; boosted trees
score them by format and context. What is to be found beyond the base spans is personal data written otherwise, so the
trees must not see what tells base spans from others: a plus, an at sign, a check digit and the range of an octet are
hidden, and spelt-out signs are read as signs. Positive are the candidates that touch a base span or pass the check of
their format (account numbers); those that fail it are known to be none and are never reported. All others are
unlabelled: some are personal data. The trees learn, on one half of all candidates, to tell positive ones from the rest;
the other half tells how they score positive ones, and so what share of the unlabelled ones with a score is
personal data (Elkan and Noto's estimate for positive and unlabelled data, generator by generator). The threshold of
each generator is where the expected precision of what is reported falls to ``precision``.

Texts are read once; their spans and candidates are all that is written. Candidates with the same features are one row with
their number, so trees and thresholds come from every one of them: the driver sums such rows itself if they are few, else
Spark does, by node and bin, and the trees are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, common

KINDS = ("email", "ip", "card", "phone", "model")

#: Fixed by the contract, written so that no long run is searched twice: a match starts where its first run starts, or
#: where the last match ended (\G), and runs give nothing back, as nothing after them could use it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Generators: parameters.
GENERATORS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?)[A-Za-z0-9-]+)+",
    r"(?<![0-9A-Za-z])[+(]?[0-9][0-9()\x20./-]{5,38}[0-9](?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
)
CONTEXT_CHARS = 32
CONTEXTS = {
    "near_contact": r"tel|phone|call|fax|mobil|móvil|handy|mail|contact|kontakt|write to|whatsapp",
    "near_account": r"card|visa|carte|tarjeta|karte|account|konto|iban|credit|payment|ssn|passport|ausweis|dni",
    "near_host": r"\bip\b|host|server|address|login",
}
FEATURES = ["generator", "n_chars", "n_digits", "n_letters", "n_blanks", "n_points", "n_dashes", "n_groups", "has_paren", *CONTEXTS]
#: What a candidate's format says of it.
FAILED, UNKNOWN, PASSED = -1, 0, 1
#: Distinct candidates that the driver holds while it grows trees; bears on cost only.
DRIVER_ROWS = 200_000
ROUNDS, BINS = 30, 8
#: Scores are told apart to this part of a log-odds.
LEVEL = 1 / 256
PRECISION = 0.9
LEAST_EACH = 30

_SPAN = "array<struct<s:int,e:int,v:string>>"


def spans(text: Column, pattern: str, guard: Column) -> Column:
    """All leftmost, non-overlapping matches as (s, e, v), in code points. ``guard`` false: none, without a search."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("g"), h.alias("h")))
    found = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["h"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + F.length(x["h"])).alias("e"), x["h"].alias("v")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(guard, found).otherwise(F.array().cast(_SPAN))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass the Luhn check."""
    plain = F.reverse(digits(v))
    doubled = F.translate(plain, "0123456789", "0246813579")
    at = F.sequence(F.lit(1), F.length(plain))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, plain.substr(i, F.lit(1))).otherwise(doubled.substr(i, F.lit(1))).cast("int"))
    return (F.length(plain) > 0) & (total % 10 == 0)


def account_check(v: Column) -> Column:
    """Whether ``v`` passes the check of international account numbers: modulo 97, letters as 10 to 35."""
    plain = F.regexp_replace(v, " ", "")
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))
    at = F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)

    def step(acc: Column, i: Column) -> Column:
        x = value(moved.substr(i, F.lit(1)))
        return (acc * F.when(x > 9, 100).otherwise(10) + x) % 97

    return F.aggregate(at, F.lit(0), step) == 1


def base_spans(text: Column) -> dict[str, Column]:
    count = lambda x: F.length(digits(x["v"]))
    return {
        "email": spans(text, EMAIL, F.instr(text, "@") > 0),
        "ip": F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["v"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": F.filter(spans(text, CARD, text.rlike(r"[0-9][0-9\x20-]{14}")), lambda x: count(x).between(16, 19) & luhn(x["v"])),
        "phone": F.filter(spans(text, PHONE, F.instr(text, "+") > 0), lambda x: count(x).between(8, 15)),
    }


def candidates(text: Column) -> Column:
    """Of all generators: (s, e, what its format says, the features)."""
    size = lambda v, pattern: F.length(v) - F.length(F.regexp_replace(v, pattern, ""))
    flag = lambda c: F.when(c, 1).otherwise(0)

    def check(g: int, v: Column) -> Column:
        if g == 1:
            octets, long = v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), v.rlike(r"^[0-9](?:[ -]?[0-9]){15,18}$")
            bad = (octets & ~v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")) | (long & ~luhn(v))
            return F.when(bad, FAILED).otherwise(UNKNOWN)
        return F.when(account_check(v), PASSED).otherwise(FAILED) if g == 2 else F.lit(UNKNOWN)

    def describe(g: int):
        def of(x: Column) -> Column:
            v, before = x["v"], F.lower(text.substr(F.greatest(x["s"] + 1 - CONTEXT_CHARS, F.lit(1)), F.least(x["s"], F.lit(CONTEXT_CHARS))))
            read = F.regexp_replace(v, r"^\+(?:[0-9]{1,3}(?=[ (]) ?)?", "")  # neither a plus nor the country's code after it
            if g == 0:
                read = F.regexp_replace(F.regexp_replace(read, r"\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?", "@"), r"\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?", ".")
            values = {
                "generator": F.lit(g), "n_chars": F.length(read), "n_digits": F.length(digits(read)), "n_letters": size(read, "[A-Za-z]"), "n_blanks": size(read, " "),
                "n_points": size(read, r"\."), "n_dashes": size(read, "-"), "n_groups": F.size(F.regexp_extract_all(read, F.lit("[0-9]+"), F.lit(0))),
                "has_paren": flag(F.instr(read, "(") > 0),
            }
            values |= {k: flag(before.rlike(p)) for k, p in CONTEXTS.items()}
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), check(g, v).alias("check"), *[values[k].cast("int").alias(k) for k in FEATURES])

        return of

    guards = (F.instr(text, "@") + F.instr(text, "at)") + F.instr(text, "at]") + F.instr(text, "at}") > 0, text.rlike("[0-9]"), text.rlike("[A-Z]{2}[0-9]{2}"))
    return F.concat(*[F.transform(spans(text, p, guard), describe(g)) for g, (p, guard) in enumerate(zip(GENERATORS, guards, strict=True))])


def touches(c: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


def expected_cut(score: np.ndarray, y: np.ndarray, open_: np.ndarray, precision: float, weight: np.ndarray | None = None) -> float:
    """The score from which on candidates are reported. score: the chance to be positive, of one generator's held-out
    candidates; y: whether they are; open_: whether they may be reported; weight: how many are alike. The chance that an open one is personal data
    is its score by the mean score of positive ones. All with a chance from some point on are reported: the mean of their
    chances is to be at least ``precision``, and none is below a half."""
    weight = np.ones(len(score)) if weight is None else weight
    typical = np.average(score[y > 0], weights=weight[y > 0])
    chance = np.minimum(score[open_] / typical, 1.0)
    order = np.argsort(-chance, kind="stable")
    chance, many = chance[order], weight[open_][order]
    means = np.cumsum(chance * many) / np.cumsum(many)
    whole = np.append(chance[1:] != chance[:-1], True) if len(chance) else np.zeros(0, bool)
    enough = np.flatnonzero((means >= precision) & whole & (chance >= 0.5))
    return float(typical * min(precision, chance[enough[-1]] if len(enough) else precision))


def train(one: DataFrame, precision: float = PRECISION) -> tuple[boosting.Boosted, dict[int, float]] | None:
    """``one``: of every candidate the features, y (whether positive), open (whether it may be reported) and half, as
    whole numbers. The trees, and the cut, in log-odds, of each generator that has enough positive candidates to tell;
    None if the trees have nothing to tell."""
    labels = ["y", "open", "half"]
    alike = common.materialize(one.groupBy(*FEATURES, *labels).agg(F.count(F.lit(1)).alias("n")), "alike")
    many = {(r.half, r.y): r.n for r in alike.groupBy("half", "y").agg(F.sum("n").alias("n")).collect()}
    if min(many.get((h, y), 0) for h in (0, 1) for y in (0, 1)) < LEAST_EACH:
        return None
    own = alike.filter("half = 1")
    values = own.select("n", F.posexplode(F.array(*FEATURES)).alias("f", "value")).groupBy("f", "value").agg(F.sum("n").alias("n")).orderBy("f", "value").toArrow()
    f, value, n = (values.column(c).to_numpy() for c in ("f", "value", "n"))
    cuts = {name: boosting.quantiles(value[f == k], n[f == k], BINS) for k, name in enumerate(FEATURES)}

    def binned(name: str) -> Column:  # a whole number stands for all between the same cuts
        out = F.lit(int(cuts[name][0]))
        for c in cuts[name]:
            out = F.when(F.col(name) > F.lit(int(c)), int(c) + 1).otherwise(out)
        return out.alias(name)

    cells = common.materialize(alike.select(*map(binned, FEATURES), *labels, "n").groupBy(*FEATURES, *labels).agg(F.sum("n").alias("n")), "cells")
    mean = many[1, 1] / (many[1, 0] + many[1, 1])
    own, other = cells.filter("half = 1"), cells.filter("half = 0")
    if cells.count() <= DRIVER_ROWS:
        held = own.toArrow()
        x = np.stack([held.column(c).to_numpy().astype(float) for c in FEATURES], 1)
        sums = boosting.local_sums(x, held.column("y").to_numpy(), held.column("n").to_numpy(), cuts)
    else:
        sums = boosting.spread_sums(own, "y", "n", cuts)
    model = boosting.boost(sums, cuts, mean, ROUNDS)
    levels = other.groupBy("generator", F.floor(model.score(F.col) / F.lit(LEVEL)).alias("level"), "y", "open").agg(F.sum("n").alias("n")).orderBy("generator", "level", "y", "open").toArrow()
    generator, level, y, open_, n = (levels.column(c).to_numpy() for c in ("generator", "level", "y", "open", "n"))
    score = 1 / (1 + np.exp(-level * LEVEL))
    found = {}
    for g in range(len(GENERATORS)):
        at = generator == g
        if n[at & (y == 1)].sum() >= LEAST_EACH:
            cut = min(max(expected_cut(score[at], y[at], open_[at] == 1, precision, n[at]), 1e-9), 1 - 1e-9)
            found[g] = float(np.log(cut / (1 - cut))) - 1e-9
    return model, found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """(id, email, ip, card, phone, model) of each row of ``docs``: arrays of spans (s, e), in code points, by start.

    Null text counts as empty. All candidates train the trees or, as the half held out, set the thresholds; with too few
    positive or other ones none is reported as ``model``, and likewise for a generator with too few positive ones. Repeated rows and ids are treated alike, texts of any length are read
    whole, other columns aren't read. Empty table: empty result.
    """
    text = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("t"))
    base = base_spans(F.col("t"))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    found = common.materialize(text.select("id", *[slim(c).alias(k) for k, c in base.items()], candidates(F.col("t")).alias("cands")), "pii")
    strict = F.concat("email", "ip", "card", "phone")
    one = found.filter(F.size("cands") > 0).select("id", strict.alias("base"), F.explode("cands").alias("c"))
    one = one.select(
        *[F.col("c")[f].alias(f) for f in FEATURES], touches(F.col("c"), F.col("base")).alias("hit"), F.col("c.check").alias("check"), F.xxhash64("id", "c.s", "c.e", "c.generator").alias("h")
    )
    labels = [(F.col("hit") | (F.col("check") == PASSED)).cast("int").alias("y"), (~F.col("hit") & (F.col("check") != FAILED)).cast("int").alias("open")]
    fitted = train(one.select(*FEATURES, *labels, F.pmod(F.shiftright("h", 32), F.lit(2)).cast("int").alias("half")), precision)
    if fitted is None or not fitted[1]:
        model = F.array().cast("array<struct<s:int,e:int>>")
    else:
        trees, cuts = fitted
        cut = lambda c: F.coalesce(*[F.when(c["generator"] == g, F.lit(x)) for g, x in cuts.items()], F.lit(float("inf")))
        chosen = F.filter("cands", lambda c: (c["check"] != FAILED) & ~touches(c, strict) & (trees.score(lambda f: c[f]) >= cut(c)))
        model = F.array_sort(F.array_distinct(F.transform(chosen, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))))
    return found.select(F.col("id").alias(id_col), "email", "ip", "card", "phone", model.alias("model"))


def joined(kinds) -> Column:
    def named(kind: str):
        return lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))

    return F.concat_ws(",", F.concat(*[F.transform(k, named(k)) for k in kinds]))


def redacted(text: Column, found: Column, mask: str = "[PII]") -> Column:
    """``text`` with the spans of ``found`` replaced; overlapping spans share one mask."""
    done = F.aggregate(
        F.array_sort(found),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))


def query(spark, sf_dir):
    out = find(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], F.sha2(joined(KINDS[:4]), 256).alias("base_sha256"), joined(KINDS).alias("spans"),
        F.size("model").cast("long").alias("n_model"),
    )
