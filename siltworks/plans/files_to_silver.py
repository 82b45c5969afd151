"""Folders of mixed files to silver, a constant number of jobs for any number of files."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import free_names, quoted
from siltworks.operators.columns import Processor, add_metadata, row_index, run_all
from siltworks.operators.dedupe import distinct_rows
from siltworks.plans.landing import JOB_ERRORS, Reader, Shape, UnsupportedFormat, file_id, inventory, known_format, land
from siltworks.session import materialize
from siltworks.sinks.files import PROCESSED_STAMP, write_table

MANIFEST = "_manifest"
MANIFEST_SCHEMA = (
    "run string, path string, length bigint, modified timestamp, fingerprint string, rows bigint, output string, written bigint, error string"
)
SOURCE_PATH, SOURCE_FILE = "source_path", "source_file"
# Ids of files are as many hexadecimal digits.
ID_DIGITS = 32
#: Rows, and bytes of source files, of one task that writes: rows carry their paths, so they are much larger there than in a shuffle.
TASK_ROWS = 1 << 16
TASK_BYTES = 1 << 26
#: Pieces of a file for each such task, which even out what a task gets.
TASK_PIECES = 8


@dataclass(frozen=True)
class RunReport:
    """One row per file in ``files``; the totals of the run beside it."""

    files: DataFrame
    start_time: datetime
    end_time: datetime

    def totals(self) -> DataFrame:
        done = F.col("error").isNull()
        return self.files.agg(
            F.count_if(done).alias("files_processed"),
            F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_rows"),
            F.count_if(~done).alias("errors"),
        )


def files_to_silver(
    spark: SparkSession,
    source: str,
    destination: str,
    suffix: str = "",
    file_format: str | None = "auto",
    output_format: str = "parquet",
    processors: Iterable[Processor] = (),
    schema: T.StructType | None = None,
    run_time: datetime | None = None,
    index_by: list[str] | None = None,
    only_new: bool = False,
    **options,
) -> RunReport:
    """Read, process, stamp, deduplicate within each file, write one folder per file.

    Every file keeps its own columns and types, found from the file itself
    (CSV, JSON, Parquet, .xlsx) or given by ``schema``. The files of a fingerprint
    are one job. A file that cannot be read or processed, or whose format is
    unknown, is reported and the rest go on; files without a byte are not listed.
    ``index_by`` numbers the rows of each
    file from 0 in that order. The columns ``source_path`` and ``source_file`` say where
    a row comes from; where the data has columns of these names, theirs are kept and
    the new ones get a longer name.

    A folder ``output=<path below the source>_processed_<run time>.<format>`` is
    complete if the manifest, a table of one row per file in ``_manifest`` below the
    destination, names it without an error: its rows are appended last.
    ``only_new`` leaves out files that the manifest has, unchanged and without an error.
    """
    start = datetime.now()
    run_time = run_time or start
    files = inventory(spark, source, suffix)
    if only_new:
        done = manifest(spark, destination).filter("error is null").select("path", "length", "modified").distinct()
        files = files.join(done, ["path", "length", "modified"], "left_anti")
    files = materialize(files, "waiting-files")
    chain, outcomes = list(processors), []
    endings = files.groupBy("ending").agg(F.min("modified").alias("oldest")).orderBy("ending").collect()
    for ending, oldest in endings:
        own = files.filter(F.col("ending") == ending)
        # The listing then leaves older files out.
        since = (oldest - timedelta(seconds=2)).strftime("%Y-%m-%dT%H:%M:%S") if only_new else None
        glob = f"*{suffix}" if suffix.lower().endswith(ending) and ending else f"*{_either_case(ending)}"
        try:
            known = known_format(ending, file_format)
            if known == "excel" and ending != ".xlsx":
                raise UnsupportedFormat(f"workbooks of the format {ending!r} cannot be read")
            landing = land(Reader(spark, source, glob, ending, own, schema, options, since), known)
        except (UnsupportedFormat, *JOB_ERRORS) as error:
            outcomes.append(_all_failed(own, str(error)))
            continue
        catalogue = materialize(landing.catalogue, "catalogue")
        unreadable = catalogue.filter(F.col("fingerprint").isNull() | F.col("reason").isNotNull())
        outcomes.append(unreadable.select("file", "fingerprint", "rows", F.lit(None).cast("string").alias("output"), F.coalesce("reason", F.lit("unreadable")).alias("error")))
        for name, shape in landing.shapes.items():
            listed = own.join(catalogue.filter(F.col("fingerprint") == name), "file").withColumn("output", output_of(F.col("relative"), run_time, output_format))
            # Written, so that its size is known: a join with it then sends no rows of data through a shuffle by file.
            listed = materialize(listed, "listed")
            job = _Job(shape, destination, output_format, chain, run_time, index_by)
            outcomes += job.run(listed, 0, 16**ID_DIGITS)
    run = uuid.uuid4().hex
    _publish(spark, files, outcomes, destination, output_format, run)
    report = manifest(spark, destination).filter(F.col("run") == run).select("path", "rows", "output", "error")
    return RunReport(report, start, datetime.now())


def manifest(spark: SparkSession, destination: str) -> DataFrame:
    """What all runs made of all files; empty before the first."""
    path = f"{destination.rstrip('/')}/{MANIFEST}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def published(spark: SparkSession, destination: str) -> DataFrame:
    """(path, output, rows, written) of every complete output, the latest of each source file."""
    done = manifest(spark, destination).filter("error is null")
    latest = F.max(F.struct("output", "rows", "written")).alias("last")
    return done.groupBy("path").agg(latest).select("path", "last.*")


def _either_case(ending: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ending)


def _all_failed(files: DataFrame, message: str) -> DataFrame:
    none = F.lit(None)
    reason = F.lit(message.split("\n")[0])
    return files.select("file", none.cast("string").alias("fingerprint"), none.cast("bigint").alias("rows"), none.cast("string").alias("output"), reason.alias("error"))


def _publish(spark, files, outcomes, destination, output_format, run) -> None:
    """Append a manifest row for every file. Written rows come from what the written files say of themselves."""
    empty = spark.createDataFrame([], "file string, fingerprint string, rows bigint, output string, error string")
    found = reduce(DataFrame.unionByName, outcomes, empty)
    counts = spark.createDataFrame([], "counted string, written bigint")
    target = f"{destination.rstrip('/')}/output=*"
    good = found.filter("error is null")
    if output_format == "parquet" and not good.isEmpty():
        written = spark.read.option("basePath", destination).schema("output string").parquet(target)
        counts = written.groupBy(F.col("output").alias("counted")).agg(F.count("*").alias("written"))
    rows = files.join(found, "file").join(counts, F.col("output") == F.col("counted"), "left")
    written = F.when(F.col("error").isNull() & F.lit(output_format == "parquet"), F.coalesce("written", F.lit(0)))
    rows = rows.withColumns({"run": F.lit(run), "written": written})
    rows.select(*T._parse_datatype_string(MANIFEST_SCHEMA).names).write.mode("append").parquet(f"{destination.rstrip('/')}/{MANIFEST}")


@dataclass(frozen=True)
class _Job:
    """The files of one fingerprint, read, processed and written together."""

    shape: Shape
    destination: str
    output_format: str
    chain: list[Processor]
    run_time: datetime
    index_by: list[str] | None

    def run(self, files: DataFrame, low: int, high: int) -> list[DataFrame]:
        """Outcomes of the files whose ids lie in [low, high).

        Usually one job. If a processor refuses a value, which no one can tell
        the file of, the range is halved until the files that fail stand alone.
        """
        end = [F.col("file") < f"{high:0{ID_DIGITS}x}"] if high < 16**ID_DIGITS else []
        own = files.filter(reduce(Column.__and__, end, F.col("file") >= f"{low:0{ID_DIGITS}x}"))
        try:
            self._write(own)
            return [own.select("file", "fingerprint", "rows", "output", F.lit(None).cast("string").alias("error"))]
        except Exception as error:  # a processor may raise anything
            if own.limit(2).count() <= 1:
                return [_all_failed(own, str(error) or type(error).__name__)]
        middle = (low + high) // 2
        return self.run(files, low, middle) + self.run(files, middle, high)

    def _write(self, files: DataFrame) -> None:
        rows, file = self._processed(files)
        taken = rows.columns
        path, name, output, piece = free_names([c for c in taken if c != file], SOURCE_PATH, SOURCE_FILE, "output", "_piece")
        size = F.greatest(F.coalesce("rows", F.lit(0)) / TASK_ROWS, F.col("length") / TASK_BYTES)
        pieces = F.greatest(F.lit(1), F.ceil(size * TASK_PIECES)).cast("int")
        own = files.select(
            F.col("file").alias("_file_key"), F.col("path").alias(path), F.element_at(F.split("path", "/"), -1).alias(name),
            F.col("output").alias(output), pieces.alias(piece),
        )
        total = files.agg(F.sum(size)).first()[0] or 0
        tasks = max(math.ceil(total), 1)
        # Equal rows of a file lie in one piece, and a small file is one; the rows of a piece meet in one task, where they are compared and written.
        named = rows.join(own, F.col(quoted(file)) == F.col("_file_key")).drop("_file_key", file)
        stamped = add_metadata(named, self.run_time)
        compared = [F.col(quoted(f.name)) for f in stamped.schema.fields if f.name != piece and not isinstance(f.dataType, T.MapType)]
        spread = [F.col(quoted(output)), F.col(piece)]
        placed = stamped.withColumn(piece, F.pmod(F.xxhash64(*compared), F.col(piece))).repartition(tasks, *spread)
        made = distinct_rows(placed)
        if self.index_by:
            made = row_index(made, self.index_by, within=[path]).repartition(tasks, *spread)
        made = made.drop(piece)
        if output != "output":
            made = made.withColumnsRenamed({"output": f"{output}_data", output: "output"})
        write_table(made, self.destination, self.output_format, "append", ["output"])

    def _processed(self, files: DataFrame) -> tuple[DataFrame, str]:
        """The processed rows, and the name of the column that has their file.

        The file is a hidden column of the read, so processors see only the data.
        Past a processor that regroups rows it can no longer be found; then it is
        added first.
        """
        if self.shape.staged:
            df, wanted = self.shape.read(), files.select(F.col("file").alias("wanted"))
            # A join by a condition keeps the hidden column, one by a name does not.
            df = df.join(wanted, F.col("file") == F.col("wanted"), "left_semi")
            data = df.drop("file")
            hidden = F.regexp_extract("_metadata.file_path", "file=([^/]*)", 1)
        else:
            data = self.shape.read(files)
            df, hidden = None, file_id()
        (file,) = free_names(data.columns, "_file")
        try:
            return run_all(data, self.chain).withColumn(file, hidden), file
        except AnalysisException:
            df = df.withColumnRenamed("file", file) if df is not None else data.withColumn(file, hidden)
            return run_all(df, self.chain), file


def output_of(relative: Column, run_time: datetime, output_format: str) -> Column:
    """Name of the output of a file: its path below the source, ending included, run time and format."""
    flat = F.replace(relative, F.lit("/"), F.lit("--"))
    # A name that holds the mark itself gets a hash, so that no two files share an output.
    name = F.when(relative.contains("--"), F.concat(flat, F.lit("-"), F.substring(F.md5(relative), 1, 8))).otherwise(flat)
    return F.concat(name, F.lit(f"_processed_{run_time.strftime(PROCESSED_STAMP)}.{output_format}"))


def output_name(relative: str, run_time: datetime, output_format: str) -> str:
    """As :func:`output_of`, for one path below the source."""
    flat = relative.replace("/", "--")
    name = f"{flat}-{hashlib.md5(relative.encode()).hexdigest()[:8]}" if "--" in relative else flat
    return f"{name}_processed_{run_time.strftime(PROCESSED_STAMP)}.{output_format}"
