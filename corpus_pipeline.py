"""A corpus pipeline: quality rules, language ID, near duplicates, packing.

Every stage takes the documents its predecessor kept, and its decisions take
effect: all but the last return rows of ``documents`` as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.names import free_names
from siltworks.llm.common import parked
from siltworks.llm.language_id import fit_language_model, keep_accepted
from siltworks.llm.ngram_join import ngram_components
from siltworks.llm.packing import pack_documents
from siltworks.llm.quality_rules import quality_rules
from siltworks.registry.base import table

# Fences and trees of hashes have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, and that column's name; ids may be missing or come twice.

    A row's number is made of its file's and its place in the file, which no
    later scan changes however it is split; what is no read of files is written first.
    """
    key, file, place, path, number = free_names(docs.columns, "row_key", "_file", "_place", "_path", "_number")
    try:
        files = docs.select(F.col("_metadata.file_path").alias("path")).distinct()
    except AnalysisException:
        docs = parked(docs, "numbered-documents")
        files = docs.select(F.col("_metadata.file_path").alias("path")).distinct()
    # As many as the listing of the read holds already.
    numbers = [(path, n) for n, path in enumerate(sorted(r["path"] for r in files.collect()))]
    named = docs.sparkSession.createDataFrame(numbers, f"{path} string, {number} long")
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    keyed = placed.join(F.broadcast(named), F.col(file) == F.col(path)).withColumn(key, F.shiftleft(number, 40) + F.col(place))
    return keyed.drop(file, place, path, number), key


def _only(keyed: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose number is the first column of ``kept``, without the number."""
    kept = kept.select(F.col(kept.columns[0]).alias("kept_key"))
    return keyed.join(kept, keyed[key] == kept["kept_key"], "left_semi").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the base rule and the bands of token fertility.

    Every row is judged by its own text, whatever its id: rows without an id and
    rows of one id stay or go one by one. Null and empty texts have too few
    words and go. An empty table stays empty.
    """
    keyed, key = _keyed(docs)
    verdicts = quality_rules(
        keyed,
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        id_col=key,
    )
    return _only(keyed, key, verdicts.filter("kept"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, by a model of the labelled ones among them.

    Every row is judged by its own text, whatever its id. Texts that are null or
    hold no letter have no language and go. An empty table stays empty.
    """
    return keep_accepted(docs, fit_language_model(docs, F.lit(True)))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts: that of the smallest id, the earliest of several.

    Rows are compared, not ids: of exact copies that share an id, or have none, one
    row stays. A row without an id stays only if no row of its component has one.
    Null and empty texts are similar to nothing and all stay.
    """
    keyed, key = _keyed(docs)
    components = ngram_components(keyed, id_col=key).select(F.col("doc_id").alias("own_key"), "component_id")
    rows = keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    chosen = rows.join(components, F.col("row") == F.col("own_key")).groupBy("component_id").agg(first.alias("first"))
    return _only(keyed, key, chosen.select("first.row"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of up to 1024 tokens.

    Every row is packed, rows of one id or without an id one by one; a null or
    empty text is its end token alone.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", join_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = parked(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
