"""Table, file and log readers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail when columns are missing. Looks at the schema only, no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str = None, required=()) -> DataFrame:
    """CSV with header, quoted line breaks and ``"`` as the escape. A given schema saves the inference scan."""
    reader = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"'))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return require_columns(reader.csv(path), required)


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table by name, or a Parquet folder when the name holds a path separator."""
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def read_log(spark: SparkSession, location: str, jdbc: dict = None) -> DataFrame:
    """An analyst log: Parquet by default, another database when ``jdbc`` gives its connection options.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` so that a long log is read
    by many tasks.
    """
    if jdbc is None:
        return read_table(spark, location)
    return spark.read.format("jdbc").option("dbtable", location).options(**jdbc).load()


def run_sql(spark: SparkSession, query: str, **params) -> DataFrame:
    """SQL text with named ``:parameters``; values are bound, never pasted into the text."""
    return spark.sql(query, args=params)
