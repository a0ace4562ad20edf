"""Plumbing for operators that need Python: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Physical operators behind which the number of partitions is only known once stages have run.
_SHUFFLES = re.compile(r"Join|Aggregate|Window|Exchange|Repartition|Limit|Offset|Sort\b")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer partitions than there are cores.

    Such an input is small by construction (each scan partition is at most
    ``spark.sql.files.maxPartitionBytes``), so the exchange is cheap; larger inputs keep their scan
    partitions, and anything behind a shuffle keeps the partitions that adaptive execution gives it."""
    if _SHUFFLES.search(df._jdf.queryExecution().sparkPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unnest(df: DataFrame, keep: Sequence[str], array: Column, pos: str, item: str) -> DataFrame:
    """A row for each element of ``array`` with its place from 0; none for an empty or null array.

    A plain explode lets the optimizer filter by the size of the array first, which makes a computed
    array twice; the outer one with a filter behind it does not."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def schema_of(ddl: str) -> StructType:
    """The Spark schema of a DDL string."""
    return _parse_datatype_string(ddl)


def map_rows(df: DataFrame, columns: Sequence[str], fn: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """Apply ``fn(*values)`` to each row's ``columns``; it yields output tuples in the order of ``ddl``.

    Only ``columns`` travel to Python, so extra columns never clash with output names."""
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(fn(*row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
