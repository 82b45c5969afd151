"""Hard negatives by exact scores, computed the Four-Russians way.

Vectors become whole numbers, and a candidate's numbers become bit planes: for
every group of eight dimensions and every binary digit one byte. For each group
a tile precomputes, for all its anchors, the sums of the anchor's components over
all 256 subsets of the group. A plane's byte then looks up what eight dimensions
add to the scores of all anchors at once; planes are shifted by their digit and
added, the sign's plane is subtracted. These are the exact inner products.

Anchors and candidates are dealt into blocks by a number of the row, whatever
their labels, and each pair of blocks is a tile. A first round of tiles scores
rows of the anchor's label and finds its positives; a second one scores all
others and keeps, for every positive, the best inside its band. Tiles return
a few rows for each anchor.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import Batches, arrow_type, parked, scan

#: A row whose squared largest component times its length reaches this could carry a score out of 64 bits.
LARGEST = 2.0**62
#: Stands for an id that is null: after all others on ties.
NO_ID = np.iinfo(np.int64).max


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(rows, planes, groups) bytes of whole numbers (rows, dims); the last plane holds the signs.

    Bit ``i`` of a byte belongs to dimension ``i`` of its group.
    """
    rows, dims = values.shape
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    digits = max(low.__invert__().bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0)
    padded = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = values
    planes = [np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(digits)]
    planes.append(np.packbits((padded < 0).astype(np.uint8), axis=1, bitorder="little"))
    return np.stack(planes, axis=1)


def values_of(planes: np.ndarray, dims: int) -> np.ndarray:
    """The whole numbers of bit planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little")[:, :, :dims].astype(np.int64)
    weights = 1 << np.arange(planes.shape[1], dtype=np.int64)
    weights[-1] *= -1  # two's complement
    return np.tensordot(bits, weights, axes=([1], [0]))


def subset_tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): sums of each anchor's components over every subset of eight dimensions."""
    n, dims = anchors.shape
    padded = np.zeros((n, -(-dims // 8) * 8), kind)
    padded[:, :dims] = anchors
    grouped = padded.reshape(n, padded.shape[1] // 8, 8).transpose(1, 2, 0)
    tables = np.zeros((grouped.shape[0], 256, n), kind)
    for i in range(8):  # subsets with dimension i are those without it, and its component
        tables[:, 1 << i : 2 << i] = tables[:, : 1 << i] + grouped[:, i : i + 1]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors): inner products by shifted sums of table lookups."""
    n, digits, groups = planes.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    for b in range(digits):
        own = np.zeros_like(total)
        for g in range(groups):
            own += tables[g][planes[:, b, g]]
        if b < digits - 1:
            total += own << b
        else:  # the signs weigh as much as the next digit would, negatively
            total -= own << b
    return total


class Side:
    """Rows of a tile: ids, labels, row numbers and bit planes; numbers of fewer planes get their signs' plane repeated."""

    def __init__(self, frame: pd.DataFrame, dims: int):
        self.ids, self.labels, self.rows = (frame[c].to_numpy(np.int64) for c in ("id", "label", "row"))
        groups = -(-dims // 8)
        self.planes = np.zeros((len(frame), 1, groups), np.uint8)
        if groups and len(frame):
            parts = [np.frombuffer(p, np.uint8).reshape(-1, groups) for p in frame.planes]
            most = max(map(len, parts))
            self.planes = np.stack([np.concatenate([p, np.repeat(p[-1:], most - len(p), axis=0)]) for p in parts])

    def of(self, at) -> "Side":
        part = object.__new__(Side)
        for name in ("ids", "labels", "rows", "planes"):
            setattr(part, name, getattr(self, name)[at])
        return part


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id; ``ids`` ascend."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
        at = np.concatenate([above, equal[: k - len(above)]])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))]


def strips(anchors: Side, candidates: Side, dims: int, rows: int):
    """(part of the candidates, scores (anchors, part)) by strips of candidates."""
    numbers = values_of(anchors.planes, dims)
    digits = candidates.planes.shape[1]
    bound = int(np.abs(numbers).sum(axis=1).max(initial=0)) << (digits + 1)
    tables = subset_tables(numbers, np.int32 if bound < 1 << 31 else np.int64)
    for at in range(0, len(candidates.ids), rows):
        part = candidates.of(slice(at, at + rows))
        yield part, np.ascontiguousarray(scores(tables, part.planes).T)


def positives_of_tile(anchors: Side, candidates: Side, dims: int, k: int, strip: int) -> pd.DataFrame:
    """(anchor, id, score): for each anchor the best rows of its label but itself."""
    out = []
    for label in np.unique(anchors.labels):
        own = anchors.of(anchors.labels == label)
        for part, score in strips(own, candidates.of(candidates.labels == label), dims, strip):
            for a, row in enumerate(own.rows):
                others = np.flatnonzero(part.rows != row)
                at = others[best(score[a, others], part.ids[others], k)]
                out += [(row, i, s) for i, s in zip(part.ids[at].tolist(), score[a, at].tolist(), strict=True)]
    return pd.DataFrame(out, columns=["anchor", "id", "score"]).astype("int64")


def negatives_of_tile(anchors: Side, candidates: Side, wanted: list[list[int]], dims: int, k: int, strip: int, band: tuple[int, int, int]) -> pd.DataFrame:
    """(anchor, positive_score, id, score): for each wanted positive score the best rows of other labels in its band."""
    low, high, whole = band
    out = []
    for part, score in strips(anchors, candidates, dims, strip):
        for a, row in enumerate(anchors.rows):
            other = part.labels != anchors.labels[a]
            for p in wanted[a]:
                # low * p <= whole * score <= high * p, in whole numbers.
                inside = np.flatnonzero(other & (score[a] >= -(-low * p // whole)) & (score[a] <= high * p // whole))
                at = inside[best(score[a, inside], part.ids[inside], k)]
                out += [(row, p, i, s) for i, s in zip(part.ids[at].tolist(), score[a, at].tolist(), strict=True)]
    return pd.DataFrame(out, columns=["anchor", "positive_score", "id", "score"]).astype("int64")


def quantised_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, factor: int) -> DataFrame:
    """(id, label, dims, planes) of the rows that take part."""
    schema = "id long, label long, dims int, planes binary"

    def run(batches: Batches) -> Batches:
        out = arrow_type(schema)
        for batch in batches:
            ids, labels, data = (batch.column(c) for c in ("id", "label", "vector"))
            rows = []
            for i, (doc, label) in enumerate(zip(ids.to_pylist(), labels.to_pylist(), strict=True)):
                vector = data[i]
                if label is None or not vector.is_valid or vector.values.null_count:
                    continue
                numbers = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * factor)
                if len(numbers) and not np.abs(numbers).max() ** 2 * len(numbers) < LARGEST:  # also refuses what is not finite
                    continue
                planes = bit_planes(numbers.astype(np.int64)[None])
                rows.append((NO_ID if doc is None else doc, label, len(numbers), planes.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    named = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vec_col].alias("vector"))
    return scan(named, {c: c for c in ("id", "label", "vector")}, run, schema)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    anchor_every: int = 100,
    relabel_every: int | None = None,
    n_labels: int = 10,
    n_positives: int = 5,
    n_negatives: int = 5,
    factor: int = 256,
    band: tuple[int, int, int] = (80, 100, 100),
    anchor_block: int = 1024,
    candidate_block: int = 8192,
    strip: int = 2048,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores exact.

    Components become ``floor(factor * x)``. Anchors are the rows whose id is a
    multiple of ``anchor_every``; their positives are the ``n_positives`` best
    other rows of their label, and each positive gets the ``n_negatives`` best
    rows of other labels with ``band[0] * p <= band[2] * n <= band[1] * p``.
    Higher scores come first, ties by smaller id, a null id last.
    ``relabel_every`` moves the label of ids it divides on by one modulo ``n_labels``.

    Rows with a null label or vector, or with null, non-finite or huge components
    (about 2^31 / sqrt(length) after scaling, where a score could leave 64 bits),
    take no part. Vectors are compared with those of their own length only. A row without
    an id is no anchor. Rows are judged one by one: a repeated row is another row
    of the same id, and a repeated anchor gets its results once for each row.
    The work is anchors x rows; no label, id or group of copies is a shuffle key.
    """
    rows = quantised_rows(vectors, id_col, vec_col, label_col, factor)
    if relabel_every:
        moves = (F.col("id") % relabel_every == 0) & (F.col("id") != NO_ID)
        rows = rows.withColumn("label", F.when(moves, (F.col("label") + 1) % n_labels).otherwise(F.col("label")))
    rows = parked(rows.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    is_anchor = (F.col("id") % anchor_every == 0) & (F.col("id") != NO_ID)
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    n_anchor, n_candidate = (max(1, math.ceil(n / size)) for n, size in ((sizes.anchors, anchor_block), (sizes.rows, candidate_block)))
    columns = ("dims", "id", "label", "row", "planes")
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(*columns, F.array().cast("array<long>").alias("wanted"), F.lit(False).alias("is_anchor"), dealt(n_candidate).alias("j"), every(n_anchor).alias("i"))

    def tiles(anchors: DataFrame) -> DataFrame:
        left = anchors.select(*columns, "wanted", F.lit(True).alias("is_anchor"), dealt(n_anchor).alias("i"), every(n_candidate).alias("j"))
        return left.unionByName(candidates).groupBy("dims", "i", "j")

    def sides(frame: pd.DataFrame) -> tuple[Side, Side, list[list[int]], int]:
        # Ids ascend, so that the first of equal scores has the smallest.
        frame = frame.sort_values(["id", "row"])
        dims, left = int(frame.dims.iloc[0]), frame[frame.is_anchor]
        return Side(left, dims), Side(frame[~frame.is_anchor], dims), [sorted(set(w)) for w in left.wanted], dims

    def find_positives(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, _, dims = sides(frame)
        return positives_of_tile(left, right, dims, n_positives, strip)

    def find_negatives(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, wanted, dims = sides(frame)
        return negatives_of_tile(left, right, wanted, dims, n_negatives, strip, band)

    order = [F.desc("score"), F.asc("id")]
    anchors = rows.filter(is_anchor).withColumn("wanted", F.array().cast("array<long>"))
    found = tiles(anchors).applyInPandas(find_positives, "anchor long, id long, score long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
    positives = parked(ranked.filter(F.col("place") <= n_positives), "positives")
    wanted = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("wanted"))
    found = tiles(rows.filter(is_anchor).join(wanted, "row")).applyInPandas(
        find_negatives, "anchor long, positive_score long, id long, score long"
    )
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(*order)))
    negatives = ranked.filter(F.col("rank") <= n_negatives).withColumnsRenamed({"anchor": "row", "id": "negative", "score": "negative_score"})
    named = positives.select(F.col("anchor").alias("row"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    named = named.join(rows.filter(is_anchor).select("row", F.col("id").alias("anchor_id")), "row")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return named.join(negatives, ["row", "positive_score"]).select(
        "anchor_id",
        real("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        real("negative").alias("negative_id"),
        "positive_score",
        "negative_score",
    )
