"""Small helpers that the operators share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark import session
from corridor_spark.session import stage_root  # noqa: F401

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Removes a query's shuffle files as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SCOPE, _STAGED = [""], defaultdict(list)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read several times, without keeping the shuffles behind it, and return the written table."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        out = session.stage(df, name)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    _STAGED[_SCOPE[-1]].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        for held in _STAGED.values():
            held[:] = [t for t in held if t is not table]


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables staged inside go when the scope is entered again: by then what was made of them must have been written."""
    discard(*_STAGED[name])
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def leave(name: str) -> None:
    """Tables staged in the scope stay from now on: what was made of them has not been written yet."""
    _STAGED.pop(name, None)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the whole text (null: empty) and the named columns; nothing else of ``docs`` is read."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold about ``chars`` bytes, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > chars:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Non-null key that orders and joins rows: null ids last, rows of one id by their text."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
                    F.xxhash64(F.coalesce(text, F.lit(""))).alias("text"))


def sample(df: DataFrame, rows: int, *columns: str, salt: int = 0) -> DataFrame:
    """The ``rows`` distinct rows of the named columns with the smallest hashes.

    Only hashes are ordered; the rows themselves are fetched once the last hash is known, so tasks send no rows that
    are not in the sample.
    """
    marked = df.select(*columns, F.xxhash64(*columns, F.lit(salt)).alias("at"))
    last = marked.groupBy("at").agg(F.lit(1).alias("one")).select("at").orderBy("at").limit(rows).agg(F.max("at")).first()[0]
    return marked.where(F.col("at") <= F.lit(last)).dropDuplicates(["at"]).orderBy("at").select(*columns)
