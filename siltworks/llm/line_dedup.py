"""Line dedup over levelled sorted runs of line hashes.

The keys that earlier batches held lie in runs: tables of 128-bit hashes,
bucketed and sorted, each with keys that no other run has. A new batch reduces
its own lines to the smallest document of every key, merge-anti-joins the runs
in their buckets, and adds what is left as a run of the lowest level. A level
that has filled is compacted into one run of the next, so there are at most
``fanout - 1`` runs on each of a logarithmic number of levels. Lines whose
(key, document) did not become part of the batch's own run are repeats.

Only built-in functions are used. Hashes travel; texts move once, at the end,
to meet the places of their repeated lines.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import parked
from siltworks.session import scratch_path

# The characters that are stripped at the ends of a line, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; text of ASCII only takes the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hashes_of(key: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


class LineRuns:
    """The keys of all batches so far, as levelled sorted runs.

    Runs are tables of the session's catalogue over files in the shared folder,
    in as many buckets as the session has shuffle partitions unless told
    otherwise, so that a batch meets them without their being shuffled.
    ``levels`` holds their names; a later session that knows the tables goes on
    from it. :meth:`forget` takes the names out of the catalogue.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None, levels: list[list[str]] | None = None):
        if fanout < 2:
            raise ValueError("a level holds two runs at least before it is compacted")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels = [list(level) for level in levels or []]

    def runs(self) -> list[DataFrame]:
        """All runs, those of the highest level first."""
        return [self.spark.table(name).select("h1", "h2") for level in reversed(self.levels) for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (h1, h2, ...) that no run holds."""
        return reduce(lambda left, run: left.join(run, ["h1", "h2"], "left_anti"), self.runs(), keys)

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        """Name and folder of a new run."""
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet")
        writer.option("path", path).saveAsTable(name)
        return name, path

    def add(self, keys: DataFrame) -> DataFrame:
        """Write the unseen ones of ``keys`` (h1, h2, first), one row a key, as a new run, compact what is full, return the run."""
        name, path = self._write(self.unseen(keys))
        self._place(name, 0)
        return self.spark.read.schema(keys.schema).parquet(path)

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            # Keys of runs differ; grouping only brings them into one order.
            rows = reduce(DataFrame.unionByName, [self.spark.table(n) for n in full])
            merged, _ = self._write(rows.groupBy("h1", "h2").agg(F.min("first").alias("first")))
            self._drop(full)
            self._place(merged, level + 1)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")

    def forget(self) -> None:
        """Take the runs out of the catalogue; their files stay with the scratch folder."""
        self._drop([name for level in self.levels for name in level])
        self.levels = []


def line_keys(docs: DataFrame, min_chars: int, batch: Column) -> DataFrame:
    """(batch, doc, fingerprint, pos, h1, h2) of every line whose key is long enough; ``docs`` has doc_id and text."""
    lines = docs.filter("doc_id is not null and text is not null").select(
        batch.alias("batch"),
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("fingerprint"),
        F.posexplode(F.split(lower_ascii(F.col("text")), "\n", -1)).alias("pos", "line"),
    )
    keys = lines.withColumn("key", F.btrim("line", F.lit(SPACES))).filter(F.length("key") >= min_chars)
    return keys.select("batch", "doc", "fingerprint", "pos", *hashes_of(F.col("key")))


def repeated_lines(keys: DataFrame, runs: LineRuns) -> DataFrame:
    """(doc, fingerprint, pos) of a batch's lines that an earlier batch or a smaller document of the batch holds; adds the batch."""
    first = keys.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    own = runs.add(first).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "first")
    # The document is part of the join key, so a line that many documents hold is no hot key here.
    same = (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("doc") == F.col("first"))
    return keys.join(own, same, "left_anti").select("doc", "fingerprint", "pos")


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of docs (doc_id, text) without the lines at the places in ``drops``."""
    places = drops.groupBy("doc", "fingerprint").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    found = docs.withColumn("own", F.xxhash64("text")).join(
        places, (F.col("doc_id") == F.col("doc")) & (F.col("own") == F.col("fingerprint")), "left"
    )
    found = found.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    # Lines between two dropped ones are cut out as a whole, which keeps this linear.
    starts = F.concat(F.array(F.lit(0)), F.transform("drops", lambda p: p + 1))
    ends = F.concat("drops", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    text = F.when(F.size("drops") > 0, F.array_join(kept, "\n")).otherwise(F.array_join("lines", "\n"))
    return found.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"), text.alias("text"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int = 4,
    fanout: int = 3,
    runs: LineRuns | None = None,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document without the lines that a document of smaller id holds.

    Lines end at a line feed; their key is the line stripped of ASCII white space
    with A-Z in lower case. Keys of fewer than ``min_chars`` characters stay. One
    row per input row. Null and empty texts are one empty line. Rows of one id are
    one document: they lose and keep the same keys, and a line that a document
    repeats stays. Rows without an id lose nothing and take nothing from others.

    ``docs`` are worked through in ``batches`` of rising ids, which bounds what a
    step sorts; the result does not depend on their number. Give ``runs`` to go
    on from earlier calls, whose documents then count as smaller ones.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    shares = [i / batches for i in range(1, batches)]
    bounds = own.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10_000)).first()[0] if shares else []
    batch = reduce(Column.__add__, [(F.col("doc_id") > b).cast("int") for b in bounds or []], F.lit(0))
    path = scratch_path(spark, "line-keys")
    keys = line_keys(own, min_chars, batch)
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    index, drops = runs or LineRuns(spark, fanout), []
    for i in range(len(bounds or []) + 1):
        drops.append(parked(repeated_lines(keys.filter(F.col("batch") == i).drop("batch"), index), "repeated-lines"))
    if runs is None:
        index.forget()
    return without_lines(own, reduce(DataFrame.unionByName, drops))
