"""Shared storage, size-checked joins and small plan helpers for the corpus operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sizes import held_bytes

#: Bytes of a keyed side that may be broadcast, by its measured widths; larger sides are shuffled.
BROADCAST_BYTES = 8 << 20
#: Copies of the smaller side of a shuffled join, so that the rows of one hot key are divided among as many tasks.
SALTS = 16

_made: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="siftlode-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def table(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that its lineage ends there; ``clean`` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftlode/{uuid.uuid4().hex}"
    _made.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(first: int = 0, last: int | None = None) -> None:
    """Removes the tables numbered ``first`` to ``last`` of those written so far; at the end of the process, all of them."""
    gone = _made[first:last]
    del _made[first:last]
    for jvm, conf, path in gone:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended, and with it the way to its files
            return


def written() -> int:
    """How many tables there are, for ``clean``."""
    return len(_made)


atexit.register(clean)


def settle(spark: SparkSession) -> None:
    """Has the driver collect its garbage, after a step whose result is a table.

    Spark removes broadcasts, and shuffle files on all executors, only when the driver's JVM finds that nothing refers to
    them; until then they add up, and its heap grows towards its limit before the JVM looks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_size(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint while its bytes are at most ``most``, else as it is (then the join shuffles)."""
    return F.broadcast(df) if held_bytes(df) <= (BROADCAST_BYTES if most is None else most) else df


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """``rows`` joined with ``small``, of at most one row for each key: broadcast where its bytes allow, else salted.

    A key that holds a large part of ``rows`` is divided among ``SALTS`` tasks; ``small`` is copied as often.
    """
    if held_bytes(small) <= (BROADCAST_BYTES if most is None else most):
        return rows.join(F.broadcast(small), keys, how)
    salt = fresh("salt", [*rows.columns, *small.columns])
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys] or rows.columns), F.lit(SALTS)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not among ``taken`` (case does not matter)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
