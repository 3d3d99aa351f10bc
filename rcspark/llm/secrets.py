"""Secret scans by dictionary-primed zstandard novelty.

Base kinds are found by pattern. Beside them, strings in a sensitive context (a word such as ``key`` or ``credential``
shortly before) are candidates: each is compressed with a dictionary made of common code identifiers and of the text
around it, and its marginal bytes, what the candidate adds to an empty frame under this dictionary, are set against
its length. Prose, identifiers and repeated values are nearly free; random strings aren't and are reported as ``novel``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "novel")

#: Fixed by the contract. ASCII: letters in either case, but not their Unicode folds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Parameters of the novelty scan.
CONTEXT_WORDS = (b"key", b"secret", b"token", b"passw", b"passphrase", b"credential", b"auth", b"private", b"bearer", b"signature")
CONTEXT = re.compile("|".join(w.decode() for w in CONTEXT_WORDS), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CONTEXT_CHARS = 48
AROUND_CHARS = 512
LEAST_NOVELTY = 0.75
#: Common names in code and configuration, as a compression dictionary.
IDENTIFIERS = (
    "import from return function class public private static void string boolean integer const let var def self this "
    "configuration environment variable parameter default settings database connection username hostname localhost "
    "application authentication authorization certificate repository development production response request "
    "initialize container exception management description information international documentation "
    "get_value set_value create_table select_from insert_into access_key secret_key api_key client_id client_secret "
    "http:// https:// www. .com .org .net /usr/local/bin /etc/ /var/log/ index.html example abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ======== -------- ________ the and that with this from have "
).encode()

_HEX_RUN = b"x" * 32
_TO_X = bytes(0x78 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end], given its surroundings and the identifiers, by its length. Exact
    repeats further on are no surroundings."""
    candidate = text[start:end].encode()
    around = text[max(0, start - AROUND_CHARS) : start] + " " + text[end : end + AROUND_CHARS].replace(text[start:end], "")
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return (len(pack.compress(candidate)) - len(pack.compress(b""))) / len(candidate)


def least_novelty(candidate: str) -> float:
    """What a random string of the candidate's alphabet reaches at any length: zstandard's entropy coder brings long
    ones down to the bits of a character, but no lower."""
    runs = (("0", "9", "9"), ("a", "f", "z"), ("A", "F", "Z"))
    size = len({c for c in candidate if not c.isalnum()})
    for low, high, end in runs:
        top = max((c for c in candidate if low <= c <= end), default="")
        size += (ord(high if top <= high else end) - ord(low) + 1) if top else 0
    return min(LEAST_NOVELTY, math.log2(size) / 8)


def _mixed(candidate: str) -> bool:
    """Of two of the three classes: lower case, upper case, digits."""
    return any(c.isdigit() for c in candidate) + any("a" <= c <= "z" for c in candidate) + any("A" <= c <= "Z" for c in candidate) >= 2


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind) in code points, sorted by start, then by kind as listed."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in raw.translate(_TO_X):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        base = sorted(found)
        starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))

        def overlaps(start: int, end: int) -> bool:
            k = bisect_left(starts, end)  # those before k start before the end
            return k > 0 and reach[k - 1] > start

        last = -1
        ahead = CANDIDATE.search(text)
        novel: set[str] = set()  # shown again after a sensitive word, they are reported again
        for c in CONTEXT.finditer(text):
            while True:
                at = max(c.end(), last)
                if ahead and ahead.start() < at:  # searched once for all words before it
                    ahead = CANDIDATE.search(text, at)
                if not ahead or ahead.start() > c.end() + CONTEXT_CHARS:
                    break
                start, last = ahead.span()
                value = text[start:last]
                if _mixed(value) and not overlaps(start, last) and (value in novel or novelty(text, start, last) >= least_novelty(value)):
                    novel.add(value)
                    found.append((start, last, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(set(found), key=lambda x: (x[0], x[2], x[1]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str | None:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    if not spans:
        return text
    out, at, merged = [], 0, []
    for s, e, _ in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_novel, base_sha256 and spans (replaced if present).

    With ``redact`` the text column holds the redacted text, else it stays. Null and empty texts have no spans (null
    stays null). Each row is scanned alone, so ties, repeated rows and empty tables need no care. Texts are scanned
    whole, in time that grows with their length and the number of candidates.
    """
    names = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    rest = docs.select(*[c for c in docs.columns if c not in names])
    kinds = {"base_sha256": "string", "spans": "string"}
    schema = rest.select("*", *[F.lit(None).cast(kinds.get(c, "long")).alias(c) for c in names]).schema
    place = rest.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, columns = b.column(place).to_pylist(), list(b.columns)
            rows = [find(x) for x in texts]
            if redact:
                columns[place] = pa.array([redacted(t, r) for t, r in zip(texts, rows, strict=True)], pa.string())
            columns += [pa.array([sum(k == kind for *_, k in r) for r in rows], pa.int64()) for kind in KINDS]
            columns.append(pa.array([hashlib.sha256(joined([x for x in r if x[2] != "novel"]).encode()).hexdigest() for r in rows], pa.string()))
            columns.append(pa.array([joined(r) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.mapInArrow(batches, schema)


def query(spark, sf_dir):
    out = scan(common.documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def stage(spark, docs, sf_dir):
    """Pipeline stage: redacts every reported span; n_chars follows the text. No row goes; nulls stay, columns of any name
    pass."""
    out = scan(docs, redact=True).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
