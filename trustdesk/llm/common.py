"""Helpers shared by the operators: Arrow maps that keep columns, shared storage, byte views of texts."""

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType


#: Input bytes that a task works on at a time.
PART_BYTES = 4 << 20


def column(name):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, keep, new):
    """The columns of ``df`` that stay beside ``new`` ones; a column with the name of a new one is replaced by it."""
    taken = {n.lower() for n in new}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def parts_of(batches):
    """Slices of about PART_BYTES of the batches of a task."""
    for batch in batches:
        rows = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def give_back():
    """Return the freed memory of a finished task to the machine: the worker process stays for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, inputs, outputs: StructType, start, keep=None) -> DataFrame:
    """Add ``outputs`` to the rows of ``df``, computed from the ``inputs`` columns batch by batch.

    ``start()`` runs once a task and returns a function from the input arrays to a list of output arrays. ``keep``
    names the columns that stay (all by default). One pass, no shuffle; a task holds one batch.
    """
    stay = kept_columns(df, keep, outputs.names)
    row = F.struct(*[column(c) for c in stay]) if stay else F.struct(F.lit(0).alias("_none"))
    source = df.select(row.alias("row"), *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    schema = StructType([source.schema["row"], *[StructField(f"out{i}", f.dataType) for i, f in enumerate(outputs)]])
    names, n = schema.names, len(inputs)

    def run(batches):
        step = None
        for part in parts_of(batches):
            step = step or start()
            made = step(*[part.column(i + 1) for i in range(n)])
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=names)
        step = part = made = None
        give_back()

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in stay],
                       *[F.col(f"out{i}").alias(n) for i, n in enumerate(outputs.names)])


def utf8(name):
    """A text column as bytes; null is empty."""
    return F.coalesce(column(name).cast("binary"), F.lit(b""))


def blobs(array) -> list:
    """Byte strings of a binary array."""
    return [b or b"" for b in array.to_pylist()]


def lists(arrays, dtype) -> pa.Array:
    """A list array from numpy arrays."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).astype(dtype) if arrays and ends[-1] else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; where it is unset, as in tests, the warehouse folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from it, which cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
