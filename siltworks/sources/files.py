"""Tables from files."""

from __future__ import annotations

import posixpath
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import quoted
from siltworks.operators.columns import standardize_names
from siltworks.operators.statistics import text_columns

# File extensions by format, and the spellings of "no value" in text files.
EXTENSIONS = {
    "csv": (".csv",),
    "json": (".json", ".jsonl"),
    "parquet": (".parquet", ".pq"),
    "orc": (".orc",),
    "excel": (".xlsx", ".xls"),
    "avro": (".avro",),
}
NULL_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

Paths = str | list[str]


class UnsupportedFormat(ValueError):
    """No reader or writer for this format."""


def extension(path: str) -> str:
    return posixpath.splitext(urlparse(path).path.rstrip("/"))[1].lower()


def detect_format(path: str) -> str:
    suffix = extension(path)
    for name, suffixes in EXTENSIONS.items():
        if suffix in suffixes:
            return name
    raise UnsupportedFormat(f"cannot tell the format of {path!r}; known extensions: {EXTENSIONS}")


def _one_format(paths: list[str]) -> str:
    formats = {detect_format(p) for p in paths}
    if len(formats) > 1:
        raise UnsupportedFormat(f"files of several formats {sorted(formats)} need one read each")
    return formats.pop()


def words_to_null(df: DataFrame, words: tuple[str, ...] = NULL_WORDS) -> DataFrame:
    """Replace the given spellings of "no value" in text columns by null."""
    names = text_columns(df)
    if not names:
        return df
    return df.withColumns({
        n: F.when(~F.col(quoted(n)).isin(list(words)), F.col(quoted(n))) for n in names
    })


def read_csv(
    spark: SparkSession,
    path: Paths,
    schema: T.StructType | None = None,
    null_words: tuple[str, ...] = ("",),
    **options,
) -> DataFrame:
    """CSV with a header row.

    Give a schema on large inputs: inference is a second pass over the text.
    Without one, columns hold what all their values fit. Further ``null_words``
    are replaced before types are inferred, so ``NA`` does not make a number
    column text.
    """
    reader = spark.read.options(header=True, **options)
    words = tuple(w for w in null_words if w)
    if schema is not None:
        return words_to_null(reader.schema(schema).csv(path), words) if words else reader.schema(schema).csv(path)
    if not words:
        return reader.option("inferSchema", True).csv(path)
    from siltworks.operators.types import apply_text_types, fit_text_types

    text = words_to_null(reader.csv(path), words)
    return apply_text_types(text, fit_text_types(text))


def read_json(spark: SparkSession, path: Paths, schema: T.StructType | None = None, lines: bool | None = None, **options) -> DataFrame:
    """JSON lines for ``.jsonl``, else one document or array per file.

    Only JSON lines can be split between tasks.
    """
    first = path if isinstance(path, str) else path[0]
    by_line = extension(first) == ".jsonl" if lines is None else lines
    reader = spark.read.options(multiLine=not by_line, **options)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: Paths, schema: T.StructType | None = None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    paths = [path] if isinstance(path, str) else path
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths)


def read_orc(spark: SparkSession, path: Paths, schema: T.StructType | None = None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).orc(path)


def read_avro(spark: SparkSession, path: Paths, schema: T.StructType | None = None, **options) -> DataFrame:
    """Avro through Spark's external module, which has to be on the class path."""
    reader = spark.read.format("avro").options(**options)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except Exception as error:
        if "spark-avro" in str(error) or "DATA_SOURCE_NOT_FOUND" in str(error) or "Avro" in str(error):
            raise UnsupportedFormat("avro needs the spark-avro package of this Spark version") from error
        raise


def _read_excel(spark: SparkSession, path: Paths, schema: T.StructType | None = None, **options) -> DataFrame:
    from siltworks.sources.excel import read_excel

    if schema is None:
        raise UnsupportedFormat("workbooks need a schema that names their columns")
    return read_excel(spark, path, schema, **options)


READERS = {
    "csv": read_csv,
    "json": read_json,
    "parquet": read_parquet,
    "orc": read_orc,
    "avro": read_avro,
    "excel": _read_excel,
}


def read_file(
    spark: SparkSession, path: Paths, file_format: str | None = None, schema: T.StructType | None = None, **options
) -> DataFrame:
    """Read by extension, or by ``file_format`` unless that is ``None`` or ``"auto"``."""
    if file_format in (None, "auto"):
        file_format = _one_format([path] if isinstance(path, str) else path)
    if file_format not in READERS:
        raise UnsupportedFormat(f"unknown file format {file_format!r}, use one of {sorted(READERS)}")
    return READERS[file_format](spark, path, schema=schema, **options)


def read_parquet_standardized(spark: SparkSession, path: Paths) -> DataFrame:
    """Parquet with standard column names; pruning and pushdown see the file's own names."""
    return standardize_names(read_parquet(spark, path))


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Add the name of the file each row came from; use it directly on a file read."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def file_stats(df: DataFrame) -> DataFrame:
    """(file, rows) of a file read; files without rows do not appear."""
    return with_source_file(df, "file").groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
