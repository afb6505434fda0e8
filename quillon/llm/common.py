"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillon.sources.storage import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage and survives lost executors.

    The table is removed when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, and lets Spark remove the files of shuffles that are over (it does when their plans are collected)."""
    spark = tables[0].sparkSession
    for t in tables:
        _remove(spark, t._written_to)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit, and with it the folder
        return


def free(df: DataFrame | Sequence[str], *names: str) -> list[str]:
    """``names``, changed where ``df`` already has such a column (in any case of letters)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: Sequence[StructField]) -> DataFrame:
    """``df`` with further columns from a function over Arrow batches, which yields all columns, those of ``df`` first.

    Columns are numbered on the way, since names with dots can't be passed to such functions.
    """
    names = [f"c{i}" for i in range(len(df.columns) + len(added))]
    fields = [*df.schema.fields, *added]
    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(names, fields)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names)

    return df.toDF(*names[: len(df.columns)]).mapInArrow(numbered, schema).toDF(*[f.name for f in fields])


def with_text(df: DataFrame, text: Column, text_col: str, chars_col: str = "n_chars") -> DataFrame:
    """``df`` with another text; a numeric column of character counts, where there is one, follows."""
    new = {text_col: text}
    kinds = {f.name: f.dataType for f in df.schema}
    if chars_col in kinds and kinds[chars_col].typeName() in ("long", "integer"):
        new[chars_col] = F.length(text).cast(kinds[chars_col])
    return df.withColumns(new)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row, however often they are used later.

    The optimizer copies an expression into each place of use (a filter, a lambda that runs for each element); it
    doesn't copy what a generator makes.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[quoted(c) for c in df.columns], F.inline(F.array(made)))
