"""What the operators share: the scratch folder that all executors see, and materialised tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    if found := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="paperloom-"))
    return spark.conf.get("spark.checkpoint.dir")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each query ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: the lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    path = f"{scratch_dir(df.sparkSession)}/paperloom-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._paperloom_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what materialise() wrote for df; df must not be read afterwards."""
    if path := getattr(df, "_paperloom_path", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def signed(bits: int) -> int:
    """64 bits as a signed number."""
    return int.from_bytes(bits.to_bytes(8, "little"), "little", signed=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (new name = type), cast; what else df has can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 1024) -> DataFrame:
    """df through make()'s function, called once a task, in Arrow batches of at most `rows` rows.

    The function returns columns as lists or arrays; a column of schema that it leaves out is the
    batch's own, unchanged (so integers keep all digits next to nulls).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = fn(part)
                columns = [made[f.name] if f.name in made else part.column(f.name) for f in target]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema=schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str = "text", rows: int = 1024) -> DataFrame:
    """The rows of df for which make()'s function of a list of the column's values says so; all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(fn(part.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, schema=df.schema)
