"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and reads it back as the next stage's documents. Stages work by row: nulls in any column, repeated rows
and ids, texts of any length, empty tables and further columns are dealt with as each stage's docstring says.
"""

from rcspark.llm import common, exact_dedup, packing, rules, secrets, simhash

STAGES = [
    ("quality_rules", rules.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", simhash.stage),
    ("secret_scan", secrets.stage),
    ("packing", packing.stage),
]

#: Tokenisation, fingerprints and compression can't be expressed in SQL: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
