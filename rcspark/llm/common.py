"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments splits on exactly these six.
SPACES = r"[\x20\x09-\x0D]+"

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own if that is unset and all
    run on this machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="rcspark-")
    return _OWN_DIR[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_dir(spark)}/rcspark/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: With this, Spark deletes an execution's shuffle files at its end.
_CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, name: str, session: SparkSession | None = None, release: bool = False, settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in ``session`` if given: cuts lineage, survives lost
    executors. With ``release`` what was shuffled for it, of no more use, is deleted at once, not when the driver
    happens to collect its plan. ``settings`` hold while it is written."""
    path = scratch_path(df.sparkSession, name)
    settings = (settings or {}) | (_CLEAN_UP if release else {})
    own = in_session(df, session_with(df.sparkSession, settings)) if settings else df
    own.write.option("compression", "zstd").parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def forget(written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, when all that reads it has been written itself."""
    for path in written.inputFiles()[:1]:
        delete_path(written.sparkSession, unquote(path.rpartition("/")[0]))


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session beside ``spark`` with its settings and these; ``spark`` keeps its own."""
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in settings.items():
        own.conf.set(key, value)
    return own


def in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    """``df``, planned and run under the settings of ``session``."""
    made = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
    return type(df)(made, session)


def small_batches(rows: int) -> dict[str, str]:
    """Settings under which Python workers, and the buffers on the way to them, hold at most ``rows`` rows at once."""
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}


def release_memory() -> None:
    """Gives what a task has freed back to the system: its worker lives on, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until it clashes with none of ``taken``."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """How many partitions hold ``bytes_each`` of the optimiser's size estimate, and at least the session's number."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size, 1 << 50) // bytes_each + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    total: int,
    max_hot: int = 1000,
) -> DataFrame:
    """Left join of ``facts`` with ``table`` (one row per key) that no hot key can overload.

    ``weight`` is the table's column with the number of fact rows of each key and ``total`` their sum. Keys that
    hold over ``total / max_hot`` rows are fewer than ``max_hot`` by counting, so this slice is broadcast whatever
    the table's size; all others go through a shuffled join in which the rows of hot keys are dealt by hash to keys
    that match nothing. Null keys match null keys. The weight column is dropped.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    names = set(facts.columns) | set(table.columns)
    mark = fresh_name(names, "hot_mark")
    spread = fresh_name(names | {mark}, "spread")
    hot_value = {v: fresh_name(names, f"hot_{v}") for v in values}
    hot_key = {k: fresh_name(names, f"hot_{k}") for k in keys}
    cold_key = {k: fresh_name(names, f"cold_{k}") for k in keys}
    is_hot = F.col(weight) * F.lit(max_hot) > F.lit(max(total, 1))
    hot = table.filter(is_hot).select(
        *[F.col(k).alias(hot_key[k]) for k in keys],
        *[F.col(v).alias(hot_value[v]) for v in values],
        F.lit(True).alias(mark),
    )
    cold = table.filter(~is_hot).select(
        *[F.col(k).alias(cold_key[k]) for k in keys], *values, F.lit(0).alias(fresh_name(names, "cold_spread"))
    )
    cold_spread = fresh_name(names, "cold_spread")
    out = facts.join(F.broadcast(hot), [F.col(k).eqNullSafe(F.col(hot_key[k])) for k in keys], "left")
    salt = F.pmod(F.xxhash64(*[c for c in facts.columns if not facts.schema[c].dataType.typeName().startswith("map")]), F.lit(1 << 20)) + 1
    out = out.withColumn(spread, F.when(F.col(mark), salt).otherwise(F.lit(0)).cast("int"))
    out = out.join(
        cold, [F.col(k).eqNullSafe(F.col(cold_key[k])) for k in keys] + [F.col(spread) == F.col(cold_spread)], "left"
    )
    return out.select(*facts.columns, *[F.coalesce(F.col(hot_value[v]), F.col(v)).alias(v) for v in values])


def text_or_empty(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def most_frequent(counts: DataFrame, column: str, room: int) -> Column:
    """A condition that at most ``room`` rows of ``counts`` meet, those with the highest counts (1 or more). Counts are
    told apart to about 1.5 %, so that a bounded number of them reaches the driver."""
    level = F.floor(F.log(F.col(column)) * 64)
    least = None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("many")).collect(), key=lambda r: -r.level):
        if row.many > room:
            break
        least, room = row.level, room - row.many
    return F.lit(False) if least is None else level >= F.lit(least)


def spread_join(facts: DataFrame, table: DataFrame, key: str, weight: str, total: int, max_hot: int = 1000, salts: int = 64) -> DataFrame:
    """Inner join of ``facts`` with ``table`` (one row per key, keys of any size) that no hot key can overload.

    ``weight``: the table's column with the number of fact rows of each key, at most; ``total``: their sum. Keys that hold
    over ``total / max_hot`` rows are fewer than ``max_hot`` by counting; only their hashes are broadcast, and their
    rows are repeated for each of ``salts`` shares of the facts. The weight column is dropped."""
    is_hot = F.col(weight) * F.lit(max_hot) > F.lit(max(total, 1))
    plain = table.drop(weight)
    if not table.filter(is_hot).limit(1).count():
        return facts.join(plain, key)
    hash_, salt, mark = (fresh_name({*facts.columns, *table.columns}, x) for x in ("hot_hash", "salt", "hot"))
    hot = table.filter(is_hot).select(F.xxhash64(key).alias(hash_)).distinct()
    dealt = facts.withColumn(mark, F.xxhash64(key)).join(F.broadcast(hot), F.col(mark) == F.col(hash_), "left")
    dealt = dealt.withColumn(salt, F.when(F.col(hash_).isNotNull(), F.pmod(F.xxhash64(*facts.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop(mark, hash_)
    # a key whose hash is a hot one's, but that isn't hot itself, is repeated as well
    shares = table.withColumn(mark, F.xxhash64(key)).join(F.broadcast(hot), F.col(mark) == F.col(hash_), "left")
    shares = shares.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(hash_).isNotNull(), F.lit(salts - 1)).otherwise(F.lit(0)))))
    return dealt.join(shares.drop(mark, hash_, weight), [key, salt]).drop(salt)
