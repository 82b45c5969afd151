"""A folder of mixed files as a catalogue of shapes and as tables of one shape each.

The catalogue is a table with one row per file: its fingerprint (column names
and types, found from the file itself), its number of records, or the reason why
it cannot be read. Text and workbooks are staged once, in folders by shape and
file, with what is needed to parse them; the files of a fingerprint are then read
by a join with the catalogue on the file, which prunes the folders of all others.
What reaches the driver are shapes and fingerprints, never files, with
one exception: Parquet files are read in place, and Spark's reader takes those
paths from the driver.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import quoted
from siltworks.session import materialize, scratch_path
from siltworks.sources.excel import parse_workbooks
from siltworks.sources.files import UnsupportedFormat, detect_format, read_file

JOB_ERRORS = (PySparkException, Py4JJavaError)
CATALOGUE = "file string, fingerprint string, rows bigint, reason string"
FILES = "path string, file string, relative string, length bigint, modified timestamp, ending string"
MALFORMED = "malformed record"
#: Bytes of a piece of a text file, and pieces of a task that stages them.
PIECE_BYTES = 1 << 23
TASK_PIECES = 4
#: Stands between no cells: a line read with it is one cell.
NO_SEPARATOR = "￿"
# Options of the text readers that the reading of lines needs too.
LINE_OPTIONS = ("encoding", "charset", "lineSep")

# Classes of cell texts, in the order in which a column gives way to the next kind.
KINDS = ("int", "bigint", "double", "date", "timestamp", "boolean", "string")


def inventory(spark: SparkSession, source: str, suffix: str = "") -> DataFrame:
    """The files below ``source``: path, an id, the path below the source, length, modification time and ending."""
    found = (
        spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").load(source)
        .select("path", file_id().alias("file"), "length", F.col("modificationTime").alias("modified"))
    )
    root = re.sub(r"^[a-z0-9]+:/*", "", source).strip("/")
    below = F.expr(f"substring_index(path, {json.dumps('/' + root + '/')}, -1)")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return found.select("path", "file", below.alias("relative"), "length", "modified", ending.alias("ending"))


def file_id() -> Column:
    """The id of the file that a row of a file read comes from."""
    return F.md5(F.col("_metadata.file_path"))


@dataclass
class Shape:
    """Rows of one fingerprint, as a frame whose hidden ``_metadata`` column still tells the file."""

    columns: T.StructType | None
    #: If staged, () -> the data columns and ``file``; else (files) -> the data columns of these files.
    read: Callable[..., DataFrame]
    staged: bool


@dataclass
class Landing:
    """What the files of one format turned out to be."""

    catalogue: DataFrame
    shapes: dict[str, Shape] = field(default_factory=dict)


def fingerprint_of(kind: str, columns: T.StructType) -> str:
    return hashlib.md5(f"{kind} {columns.json()}".encode()).hexdigest()


def _failed(files: DataFrame, reason: str) -> DataFrame:
    none = F.lit(None)
    return files.select("file", none.cast("string").alias("fingerprint"), none.cast("bigint").alias("rows"), F.lit(reason.split("\n")[0]).alias("reason"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOGUE)


@dataclass
class Reader:
    """Where the waiting files are and how they are to be read."""

    spark: SparkSession
    source: str
    glob: str
    ending: str
    files: DataFrame  # the waiting files of this ending
    schema: T.StructType | None
    options: dict
    since: str | None = None

    def load(self, file_format: str, **options) -> DataFrame:
        """A read of the folder; files older than all waiting ones are not opened."""
        reader = self.spark.read.format(file_format).options(recursiveFileLookup=True, pathGlobFilter=self.glob, **options)
        return (reader.option("modifiedAfter", self.since) if self.since else reader).load(self.source)

    def lines(self, **options) -> DataFrame:
        """(file, value): the text of the waiting files."""
        own = {k: v for k, v in self.options.items() if k in LINE_OPTIONS}
        lines = self.load("text", **own, **options).select(file_id().alias("file"), "value")
        return lines.join(self.files.select("file"), "file", "left_semi")


def land(reader: Reader, file_format: str) -> Landing:
    """Catalogue the waiting files and stage what cannot be read in place."""
    by_line = {"csv": _land_csv, "json": _land_json, "excel": _land_workbooks, "parquet": _land_parquet}
    if file_format == "csv" and str(reader.options.get("multiLine", False)).lower() == "true":
        return _land_whole(reader, file_format)
    return by_line.get(file_format, lambda r: _land_whole(r, file_format))(reader)


def _staged(rows: DataFrame) -> str:
    """Write rows with columns ``shape`` and ``file`` to folders of their own."""
    path = scratch_path(rows.sparkSession, "staged")
    rows.hint("rebalance", F.col("shape"), F.col("file")).write.partitionBy("shape", "file").parquet(path)
    return path


def _staged_lines(rows: DataFrame, files: DataFrame) -> str:
    """As :func:`_staged`, for texts of files whose shape is known; many tasks write a large file.

    The ids beside every text hardly show in the bytes of a shuffle, but do in the
    memory of a task, so tasks are given bytes of the files themselves.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / PIECE_BYTES))
    own = files.select("file", "shape", pieces.alias("pieces"))
    tasks = max(math.ceil((files.agg(F.sum("length")).first()[0] or 0) / PIECE_BYTES / TASK_PIECES), 1)
    # Numbered as they are read, so that a task that runs again deals them out alike.
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).join(own, "file")
    dealt = dealt.withColumn("piece", F.pmod("place", "pieces")).repartition(tasks, "shape", "file", "piece")
    path = scratch_path(rows.sparkSession, "staged")
    dealt.drop("place", "pieces", "piece").write.partitionBy("shape", "file").parquet(path)
    return path


def _read_staged(spark: SparkSession, path: str, shape: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}, file string").parquet(f"{path}/shape={shape}")


# --------------------------------------------------------------------------
# Cells: CSV and workbooks


def kind_of(c: Column) -> Column:
    """The place in ``KINDS`` of a text, null for null."""
    number = c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | c.isin("NaN", "Infinity", "-Infinity")
    whole = c.rlike(r"^[+-]?\d{1,19}$")
    moment = c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$")
    return (
        F.when(c.isNull(), None)
        .when(whole & c.try_cast("int").isNotNull(), 0)
        .when(whole & c.try_cast("bigint").isNotNull(), 1)
        .when(number, 2)
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), 3)
        .when(moment & c.try_cast("timestamp").isNotNull(), 4)
        .when(F.lower(c).isin("true", "false"), 5)
        .otherwise(6)
    )


def column_kind(low: Column, high: Column) -> Column:
    """The kind of a column from the least and greatest kind of its values: numbers widen, dates widen to times, all else is text."""
    same = (high <= 2) | ((low >= 3) & (high <= 4)) | (low == high)
    return F.when(same, high).otherwise(6)


def column_names(header: list[str | None]) -> list[str]:
    """Titles to names: an empty one counts its place, repeated ones get their place behind."""
    titles = [t if t else f"_c{i}" for i, t in enumerate(header)]
    lower = [t.lower() for t in titles]
    return [f"{t}{i}" if lower.count(t.lower()) > 1 else t for i, t in enumerate(titles)]


def _cells_landing(spark: SparkSession, kind: str, headers: dict[str, list[str]], read, refused: DataFrame, files: DataFrame) -> Landing:
    """Types by file, in one job over all shapes, and a shape for every combination of header and types.

    ``read(shape)`` gives columns c0, c1, ... of text, ``file`` and ``bad``;
    ``files`` has file and shape of every readable file, ``refused`` is their catalogue for the others.
    """
    parts = []
    for shape, header in headers.items():
        rows = read(shape)
        kinds = [kind_of(F.col(f"c{i}")) for i in range(len(header))]
        found = F.array(*[column_kind(F.min(k), F.max(k)) for k in kinds]).cast("array<int>")
        parts.append(rows.groupBy("file").agg(F.lit(shape).alias("shape"), F.count("*").alias("rows"), F.max("bad").alias("bad"), found.alias("kinds")))
    if not parts:
        return Landing(refused)
    judged = reduce(DataFrame.unionByName, parts).drop("shape")
    judged = materialize(files.select("file", "shape").join(judged, "file", "left").join(refused.select("file"), "file", "left_anti"), "kinds")
    good = ~F.coalesce("bad", F.lit(False))
    shapes, names = {}, []
    for r in judged.filter(good).select("shape", "kinds").distinct().collect():
        header = headers[r["shape"]]
        found = [6 if k is None else k for k in r["kinds"] or [None] * len(header)]
        columns = T.StructType([T.StructField(n, T._parse_datatype_string(KINDS[k])) for n, k in zip(column_names(header), found, strict=True)])
        name = fingerprint_of(kind, columns)
        names.append((r["shape"], r["kinds"], name))

        def rows(shape=r["shape"], columns=columns) -> DataFrame:
            typed = [F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(columns)]
            return read(shape).select("file", *typed)

        shapes.setdefault(name, []).append((columns, rows))
    named = spark.createDataFrame(names, "shape string, kinds array<int>, fingerprint string")
    same = (judged["shape"] == named["shape"]) & judged["kinds"].eqNullSafe(named["kinds"])
    catalogue = judged.join(F.broadcast(named), same & good, "left").select(
        judged["file"],
        "fingerprint",
        F.when(good, F.coalesce("rows", F.lit(0))).alias("rows"),
        F.when(~good, MALFORMED).alias("reason"),
    )
    # Two headers may spell the same names; their rows stand below each other.
    made = {n: Shape(own[0][0], lambda own=own: reduce(DataFrame.unionByName, [rows() for _, rows in own]), True) for n, own in shapes.items()}
    return Landing(catalogue.unionByName(refused), made)


def _land_csv(reader: Reader) -> Landing:
    """CSV: one job finds the headers, one stages the lines behind them, one finds malformed records and types."""
    spark, options = reader.spark, {k: v for k, v in reader.options.items() if k not in ("header", "mode", "inferSchema")}
    heads = reader.load("text", **{k: v for k, v in options.items() if k in LINE_OPTIONS})
    heads = heads.filter((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    heads = heads.select(file_id().alias("file"), "value", F.monotonically_increasing_id().alias("place"))
    heads = heads.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    # An empty file has no columns, unless they are given.
    files = reader.files.select("file", "length").join(heads, "file", "left").withColumn("shape", F.md5("header"))
    files = materialize(files, "headers")
    refused = _failed(files.filter("header is null"), "no columns to read")
    files = files.filter("header is not null")
    found = files.select("shape", "header").distinct().collect()
    headers = {r["shape"]: _titles(r["header"], options) for r in found}
    plain = {k: v for k, v in options.items() if k in LINE_OPTIONS}
    lines = reader.spark.read.schema("value string").options(
        header=True, sep=NO_SEPARATOR, quote="", recursiveFileLookup=True, pathGlobFilter=reader.glob, **plain,
        **({"modifiedAfter": reader.since} if reader.since else {}),
    ).csv(reader.source)
    lines = lines.select(file_id().alias("file"), "value")
    staged = _staged_lines(lines, files)
    bad = "_bad_record"

    def read(shape: str) -> DataFrame:
        fields = ", ".join(f"c{i} string" for i in range(len(headers[shape])))
        parsed = F.from_csv("value", f"{fields}, {bad} string", {**options, "columnNameOfCorruptRecord": bad})
        rows = _read_staged(spark, staged, shape, "value string").select("file", parsed.alias("r"))
        return rows.select("file", "r.*").withColumn("bad", F.col(bad).isNotNull()).drop(bad)

    if reader.schema is not None:
        return _given_csv(reader, files, staged, list(headers), refused, options)
    existing = _existing(spark, staged, headers)
    return _cells_landing(spark, "csv", headers, lambda s: read(s) if s in existing else _no_cells(spark, len(headers[s])), refused, files)


def _titles(header: str, options: dict) -> list[str]:
    """The titles of a header line."""
    separator = options.get("sep", options.get("delimiter", ","))
    return next(csv.reader([header], delimiter=separator, quotechar=options.get("quote", '"') or None), [])


def _no_cells(spark: SparkSession, width: int) -> DataFrame:
    return spark.createDataFrame([], ", ".join(["file string", *[f"c{i} string" for i in range(width)], "bad boolean"]))


def _existing(spark: SparkSession, staged: str, shapes) -> set[str]:
    """The shapes that any row was staged of."""
    found = spark.read.schema("shape string").format("parquet").load(staged).select("shape").distinct().collect()
    return {r["shape"] for r in found} & set(shapes)


def _given_csv(reader: Reader, files: DataFrame, staged: str, shapes: list[str], refused: DataFrame, options: dict) -> Landing:
    """CSV by a given schema, which names the columns by their place."""
    spark, bad = reader.spark, "_bad_record"
    full = T.StructType([*reader.schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_csv("value", full.toDDL(), {**options, "columnNameOfCorruptRecord": bad}).alias("r")
    existing = _existing(spark, staged, shapes)

    def rows() -> DataFrame:
        own = [_read_staged(spark, staged, s, "value string") for s in shapes if s in existing]
        none = spark.createDataFrame([], "value string, file string")
        return reduce(DataFrame.unionByName, own or [none]).select("file", parsed)

    return _given(reader, files, refused, rows, bad)


def _given(reader: Reader, files: DataFrame, refused: DataFrame, rows, bad: str) -> Landing:
    """A landing of one shape, whose rows are ``file`` and a struct ``r`` of the given schema and ``bad``."""
    name = fingerprint_of("given", reader.schema)
    # The hash keeps every field in the parse: a record is judged by all of them.
    fields = [F.col(f"r.{quoted(f.name)}") for f in reader.schema]
    judged = rows().groupBy("file").agg(F.count("*").alias("rows"), F.max(F.col(f"r.{bad}").isNotNull()).alias("bad"), F.max(F.xxhash64(*fields)).alias("seen"))
    catalogue = files.select("file").join(judged, "file", "left").select(
        "file",
        F.when(~F.coalesce("bad", F.lit(False)), name).alias("fingerprint"),
        F.when(~F.coalesce("bad", F.lit(False)), F.coalesce("rows", F.lit(0))).alias("rows"),
        F.when(F.col("bad"), MALFORMED).alias("reason"),
    )
    return Landing(catalogue.unionByName(refused), {name: Shape(reader.schema, lambda: rows().select("file", *[f.alias(s.name) for f, s in zip(fields, reader.schema, strict=True)]), True)})


def _land_workbooks(reader: Reader) -> Landing:
    """First sheets of workbooks; each is parsed once, into a table of its cells."""
    content = reader.load("binaryFile").select(file_id().alias("path"), "content")
    waiting = content.join(reader.files.select(F.col("file").alias("path")), "path", "left_semi")
    rows = parse_workbooks(waiting).withColumnRenamed("path", "file")
    staged = _staged(rows.withColumn("shape", F.coalesce(F.md5(F.to_json("header")), F.lit("none"))))
    spark, fields = reader.spark, "row_idx int, header array<string>, cells array<string>, error string, shape string, file string"
    kept = spark.read.schema(fields).parquet(staged)
    refused = kept.filter("error is not null").groupBy("file").agg(F.first("error").alias("reason"))
    refused = refused.select("file", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("bigint").alias("rows"), "reason")
    found = kept.filter("error is null").select("shape", "header").distinct().collect()
    headers = {r["shape"]: list(r["header"]) for r in found if r["header"]}
    files = kept.filter(F.col("shape").isin(list(headers))).select("file", "shape").distinct()
    # A sheet without a row below its titles leaves nothing behind.
    silent = reader.files.select("file").join(kept.select("file").distinct(), "file", "left_anti")
    refused = refused.unionByName(_failed(silent, "no rows to read"))

    def read(shape: str) -> DataFrame:
        own = _read_staged(spark, staged, shape, "cells array<string>")
        extra = F.coalesce(F.size("cells"), F.lit(0)) > len(headers[shape])
        return own.select("file", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(headers[shape]))], extra.alias("bad"))

    return _cells_landing(spark, "excel", headers, read, refused, files)


# --------------------------------------------------------------------------
# JSON


def columns_of_variant(schema: Column) -> Column:
    """The schema that a variant's one stands for: fractions as doubles, what has no one type as text."""
    text = F.regexp_replace(schema, r"DECIMAL\(\d+,\d+\)", "DOUBLE")
    text = F.regexp_replace(text, r"\bOBJECT<", "STRUCT<")
    return F.regexp_replace(text, r"(: |<)(VOID|VARIANT)(?=[,>])", "$1STRING")


def _documents(texts: DataFrame) -> DataFrame:
    """Whole files as documents; one whose first line is a record and not its last holds a record a line."""
    whole = F.btrim("value", F.lit(" \t\r\n"))
    first = F.substring_index(whole, "\n", 1)
    by_line = (first != whole) & first.startswith("{") & F.call_function("try_parse_json", first).isNotNull()
    return texts.select("file", F.explode(F.when(by_line, F.split("value", "\n")).otherwise(F.array("value"))).alias("value"))


def _land_json(reader: Reader) -> Landing:
    """JSON documents or lines: one job finds the schema of every file, one stages texts by schema."""
    spark, options = reader.spark, {k: v for k, v in reader.options.items() if k not in ("mode", "multiLine", "lines")}
    by_line = reader.options.get("lines")
    by_line = (reader.ending == ".jsonl" and not reader.options.get("multiLine")) if by_line is None else by_line
    texts = reader.lines() if by_line else _documents(reader.lines(wholetext=True))
    texts = texts.filter(F.trim("value") != "")
    variant = F.expr("try_parse_json(value)")
    n = F.lit(1) if by_line else F.coalesce(F.json_array_length("value"), F.lit(1))
    judged = texts.withColumn("v", variant).groupBy("file").agg(
        F.sum(n).alias("rows"), F.max(F.col("v").isNull()).alias("bad"), columns_of_variant(F.expr("schema_of_variant_agg(v)")).alias("schema")
    )
    listed = F.col("schema").startswith("ARRAY<STRUCT<")
    bad = F.col("bad") | ~(listed | F.col("schema").startswith("STRUCT<"))
    judged = judged.select("file", "rows", "schema", bad.alias("bad"), F.md5("schema").alias("shape"))
    judged = materialize(reader.files.select("file", "length").join(judged, "file", "left"), "json-schemas")
    refused = _failed(judged.filter("bad is null"), "no records to read").unionByName(_failed(judged.filter("bad"), MALFORMED))
    files = judged.filter("not bad")
    staged = _staged_lines(texts, files)
    found = files.select("shape", "schema").distinct().collect()
    if reader.schema is not None:
        corrupt = "_bad_record"
        full = T.StructType([*reader.schema.fields, T.StructField(corrupt, T.StringType())])

        def given() -> DataFrame:
            own = [_read_staged(spark, staged, r["shape"], "value string") for r in found]
            none = spark.createDataFrame([], "value string, file string")
            parsed = F.from_json("value", T.ArrayType(full), {**options, "columnNameOfCorruptRecord": corrupt})
            one = F.from_json("value", full, {**options, "columnNameOfCorruptRecord": corrupt})
            rows = reduce(DataFrame.unionByName, own or [none])
            return rows.select("file", (one if by_line else F.explode(parsed)).alias("r"))

        return _given(reader, files, refused, given, corrupt)
    shapes = {}
    names = []
    for r in found:
        kind = T._parse_datatype_string(r["schema"])
        columns = kind.elementType if isinstance(kind, T.ArrayType) else kind
        name = fingerprint_of("json", columns)
        names.append((r["shape"], name))

        def rows(shape=r["shape"], kind=kind) -> DataFrame:
            parsed = F.from_json("value", kind, options)
            own = _read_staged(spark, staged, shape, "value string")
            return own.select("file", (F.explode(parsed) if isinstance(kind, T.ArrayType) else parsed).alias("r")).select("file", "r.*")

        shapes.setdefault(name, []).append((columns, rows))
    if not names:
        return Landing(refused)
    named = spark.createDataFrame(names, "shape string, fingerprint string")
    catalogue = files.join(F.broadcast(named), "shape").select("file", "fingerprint", "rows", F.lit(None).cast("string").alias("reason"))
    made = {n: Shape(own[0][0], lambda own=own: reduce(DataFrame.unionByName, [rows() for _, rows in own]), True) for n, own in shapes.items()}
    return Landing(catalogue.unionByName(refused), made)


# --------------------------------------------------------------------------
# Formats read in place


def footer_schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Schema as JSON and rows of Parquet files from the ends of their bytes."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    for batch in batches:
        out = []
        for file, tail in zip(batch["file"], batch["tail"], strict=True):
            try:
                found = pq.ParquetFile(io.BytesIO(tail))
                own = (found.schema_arrow.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
                schema = own.decode() if own else from_arrow_schema(found.schema_arrow.remove_metadata()).json()
                out.append((file, schema, found.metadata.num_rows, None))
            except Exception as error:  # whatever a damaged footer makes of the parser
                out.append((file, None, None, f"not a readable Parquet file: {type(error).__name__}"))
        yield pd.DataFrame(out, columns=["file", "schema", "rows", "reason"]).astype({"rows": "Int64"})


def _land_parquet(reader: Reader) -> Landing:
    """Parquet: one job reads the footers; the files of a fingerprint are read in place."""
    content = reader.load("binaryFile").select(file_id().alias("file"), "content")
    size = F.hex(F.substring("content", -8, 4))
    # The footer's length is a little-endian number before the last four bytes.
    size = F.conv(F.concat(*[F.substring(size, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    known = F.when((F.length("content") > 12) & (size < F.length("content")), size).otherwise(0)
    tail = F.expr("substring(content, -cast(least(tail_size, length(content)) as int))")
    waiting = content.withColumn("tail_size", known + 8).select("file", tail.alias("tail"))
    waiting = waiting.join(reader.files.select("file"), "file", "left_semi")
    judged = materialize(waiting.mapInPandas(footer_schemas, "file string, schema string, rows bigint, reason string"), "footers")
    shapes, names = {}, []
    for r in judged.filter("schema is not null").select("schema").distinct().collect():
        columns = reader.schema or T.StructType.fromJson(json.loads(r["schema"]))
        name = fingerprint_of("parquet", columns)
        names.append((r["schema"], name))
        shapes[name] = _in_place(reader, "parquet", columns)
    named = reader.spark.createDataFrame(names, "schema string, fingerprint string")
    catalogue = judged.join(named, "schema", "left").select("file", "fingerprint", "rows", "reason")
    return Landing(catalogue, shapes)


def _in_place(reader: Reader, file_format: str, columns: T.StructType | None) -> Shape:
    def read(files: DataFrame) -> DataFrame:
        paths = sorted(r["path"] for r in files.select("path").toLocalIterator())
        return read_file(reader.spark, paths, file_format, columns, **_settings(reader.options, file_format))

    return Shape(columns, read, False)


def _settings(options: dict, file_format: str) -> dict:
    settings = dict(options)
    if file_format in ("csv", "json"):
        settings.setdefault("mode", "FAILFAST")
    return settings


def _land_whole(reader: Reader, file_format: str) -> Landing:
    """Formats whose files are told apart only by reading them: all of an ending are one shape."""
    name = fingerprint_of(file_format, reader.schema or T.StructType())
    catalogue = reader.files.select("file", F.lit(name).alias("fingerprint"), F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("string").alias("reason"))
    return Landing(catalogue, {name: _in_place(reader, file_format, reader.schema)})


def known_format(ending: str, file_format: str | None) -> str:
    return detect_format(f"x{ending}") if file_format in (None, "auto") else file_format


