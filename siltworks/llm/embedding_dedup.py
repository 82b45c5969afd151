"""Near duplicates among embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class. Pivots from a bounded sample cut the space into
cells; a class lies in the cell of its nearest pivot and visits each lower cell
that a linked vector could lie in, which half-spaces between pivots decide
exactly. Cells are dealt into blocks, pairs of blocks are tiles. A tile
quantises its unit vectors to int8 and knows the length of each vector's
rounding error, so the integer products bound every cosine from both sides; only
pairs that the bounds leave open are computed again in double precision. A tile
returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import Batches, arrow_type, parked, scan
from siltworks.llm.components import connected_components, forest

#: Rows of a tile whose products are held at once.
STRIP = 1024
#: More than all rounding of double arithmetic on unit vectors.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 components, their common scale, and the length of each row's rounding error."""
    scale = max(float(np.abs(unit).max()), 1e-300) / 127
    whole = np.rint(unit / scale).astype(np.int8)
    return whole, scale, np.sqrt(((unit - whole * scale) ** 2).sum(axis=1))


def links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (``a`` with itself, each pair once, if None) with cosine >= threshold."""
    same = b is None
    b = a if same else b
    length_a, length_b = np.sqrt((a**2).sum(axis=1)), np.sqrt((b**2).sum(axis=1))
    unit_a, unit_b = a / length_a[:, None], b / length_b[:, None]
    int_a, scale_a, error_a = quantised(unit_a)
    int_b, scale_b, error_b = quantised(unit_b)
    # Sums of int8 products are exact in this type: 127 * 127 * dimensions stays below its whole numbers.
    kind = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    left, right, scale = int_a.astype(kind), int_b.astype(kind).T.copy(), scale_a * scale_b
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(a), STRIP):
        first = at if same else 0
        products = left[at : at + STRIP] @ right[:, first:]
        errors = error_a[at : at + STRIP]
        least = (threshold - SLACK - errors - error_b.max() * (1 + errors)) / scale
        i, j = np.nonzero(products >= least[:, None].astype(kind) - 1)
        if same:
            i, j = i[j > i], j[j > i]
        for part in range(0, len(i), 1 << 17):
            p, q = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            value = products[p, q].astype(np.float64) * scale
            p, q = p + at, q + first
            margin = error_a[p] + error_b[q] + error_a[p] * error_b[q] + SLACK
            sure, open_ = value - margin >= threshold, (value - margin < threshold) & (value + margin >= threshold)
            exact = np.zeros(len(p))
            exact[open_] = np.einsum("ij,ij->i", a[p[open_]], b[q[open_]]) / (length_a[p[open_]] * length_b[q[open_]])
            linked = sure | open_ & (exact >= threshold)
            found_a.append(p[linked])
            found_b.append(q[linked])
    return np.concatenate(found_a), np.concatenate(found_b)


def pivots_from(sample: np.ndarray, wanted: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Directions by spherical k-means."""
    unit = sample / np.sqrt((sample**2).sum(axis=1))[:, None]
    pivots = unit[np.random.default_rng(seed).choice(len(unit), min(wanted, len(unit)), replace=False)]
    for _ in range(rounds):
        nearest = (unit @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, unit)
        length = np.sqrt((sums**2).sum(axis=1))
        pivots = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], pivots)
    return pivots


def cells_of(unit: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and a mask of the lower cells within ``reach`` of it.

    Points of cell k lie on k's side of the plane halfway between pivot k and the
    vector's own, so the distance to that plane bounds the distance to them.
    """
    products = unit @ pivots.T
    home = products.argmax(axis=1)
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0))
    gap = products[np.arange(len(unit)), home][:, None] - products
    visits = gap <= (reach + SLACK) * apart[home] + SLACK
    return home, visits & (np.arange(len(pivots))[None] < home[:, None])


def _fingerprinted(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    schema = "vec_id long, k1 long, k2 long, vector binary"

    def run(batches: Batches) -> Batches:
        out = arrow_type(schema)
        for batch in batches:
            column = batch.column("embedding").cast(pa.list_(pa.float64()))
            values = column.values.to_numpy(zero_copy_only=False).astype("<f8")
            offsets, null = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            rows = []
            for i, vec_id in enumerate(batch.column("vec_id").cast(pa.int64()).to_pylist()):
                own = values[offsets[i] : offsets[i + 1]] + 0.0  # no negative zeros
                with np.errstate(all="ignore"):
                    length = np.sqrt((own**2).sum())
                if vec_id is None or null[i] or not len(own) or not np.isfinite(own).all() or not np.isfinite(length) or length == 0:
                    rows.append((vec_id, None, None, None))
                else:
                    data = own.tobytes()
                    key = np.frombuffer(xxhash.xxh3_128_digest(data), "<i8")
                    rows.append((vec_id, int(key[0]), int(key[1]), data))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return scan(vectors, {"vec_id": id_col, "embedding": vec_col}, run, schema)


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = 8192,
    max_cells: int = 512,
    sample_rows: int = 8192,
) -> DataFrame:
    """Links, component and verdict of every vector; linked are pairs of cosine >= ``threshold``.

    One row per input row. Vectors that are null, empty or zero, or that hold
    null or non-finite components, and rows without an id link with nothing; such
    a row without an id has no component and is kept. Equal vectors are linked
    and counted without being compared; vectors of different dimensions are not
    linked. A linked component is named by its smallest id, which is kept.
    Products of a tile grow with the square of its rows, as any exact comparison
    of unclustered vectors; the cells save what lies apart.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    rows = parked(_fingerprinted(vectors, id_col, vec_col), "vectors")
    classes = parked(
        rows.filter("vector is not null")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
        .withColumn("dim", F.octet_length("vector")),
        "vector-classes",
    )
    n_classes = classes.count()
    dims = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    pivots, main_dim = None, dims[0].dim if dims else 0
    n_cells = min(max_cells, math.ceil(n_classes / block_rows))
    if n_cells > 1:
        sample = classes.filter(F.col("dim") == main_dim).orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("vector").collect()
        pivots = pivots_from(np.array([np.frombuffer(r.vector, "<f8") for r in sample]), n_cells)
    reach = math.sqrt(2 - 2 * threshold)
    schema = "dim int, cell int, visitor boolean, rep long, size long, vector binary"

    def place(batches: Batches) -> Batches:
        out = arrow_type(schema)
        for batch in batches:
            rep, size, dim, data = (batch.column(c).to_pylist() for c in ("rep", "size", "dim", "vector"))
            placed = []
            for i in range(len(rep)):
                if pivots is None or dim[i] != main_dim:
                    placed.append((i, 0, False))
            own = [i for i in range(len(rep)) if dim[i] == main_dim] if pivots is not None else []
            for at in range(0, len(own), STRIP):
                part = own[at : at + STRIP]
                matrix = np.array([np.frombuffer(data[i], "<f8") for i in part])
                home, visits = cells_of(matrix / np.sqrt((matrix**2).sum(axis=1))[:, None], pivots, reach)
                placed += [(i, int(c), False) for i, c in zip(part, home, strict=True)]
                placed += [(part[k], int(c), True) for k, c in zip(*np.nonzero(visits), strict=True)]
            columns = [[dim[i] for i, _, _ in placed], [c for _, c, _ in placed], [v for _, _, v in placed]]
            columns += [[source[i] for i, _, _ in placed] for source in (rep, size, data)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    placed = scan(classes, {c: c for c in ("rep", "size", "dim", "vector")}, place, schema)
    placed = parked(placed, "vector-cells")
    blocks = lambda visitor: F.ceil(F.count(F.when(F.col("visitor") == visitor, 1)) / block_rows).cast("int")
    # A row for each cell and dimension: max_cells and the few dimensions of a table.
    counts = placed.groupBy("dim", "cell").agg(blocks(False).alias("homes"), blocks(True).alias("guests"))
    dealt = placed.join(F.broadcast(counts), ["dim", "cell"]).withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    )
    # A home block meets every home block once and every block of visitors.
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda guest, i, j, left: F.struct(F.lit(guest).alias("guest"), i.alias("i"), j.alias("j"), left.alias("left"))
    own = F.col("own")
    home_tiles = F.transform(upto("homes"), lambda j: tile(False, F.least(own, j), F.greatest(own, j), own <= j))
    guest_tiles = F.transform(upto("guests"), lambda j: tile(True, own, j, F.lit(True)))
    visits = F.transform(upto("homes"), lambda i: tile(True, i, own, F.lit(False)))
    tiles = dealt.select(
        "dim", "cell", "rep", "size", "vector",
        F.explode(F.when(F.col("visitor"), visits).otherwise(F.concat(home_tiles, guest_tiles))).alias("tile"),
    ).select("dim", "cell", "tile.*", "rep", "size", "vector")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        sides = [frame[frame.left], frame[~frame.left]]
        same = not frame.guest.iloc[0] and frame.i.iloc[0] == frame.j.iloc[0]
        empty = pd.DataFrame({"rep": [], "other": [], "weight": []})
        if not len(sides[0]) or not (same or len(sides[1])):
            return empty
        if same:
            sides[1] = sides[0]
        matrices = [np.array([np.frombuffer(v, "<f8") for v in s.vector]) for s in sides]
        p, q = links(matrices[0], None if same else matrices[1], threshold)
        reps, sizes = [s.rep.to_numpy() for s in sides], [s["size"].to_numpy() for s in sides]
        child, root = forest(reps[0][p], reps[1][q])
        weight_a = np.bincount(p, sizes[1][q], len(reps[0])).astype(np.int64)
        weight_b = np.bincount(q, sizes[0][p], len(reps[1])).astype(np.int64)
        counted = [pd.DataFrame({"rep": r[w > 0], "other": pd.NA, "weight": w[w > 0]}) for r, w in zip(reps, (weight_a, weight_b), strict=True)]
        out = pd.concat([pd.DataFrame({"rep": child, "other": root, "weight": 0}), *counted], ignore_index=True)
        return out.astype({"rep": "Int64", "other": "Int64", "weight": "Int64"})

    found = parked(tiles.groupBy("dim", "cell", "guest", "i", "j").applyInPandas(compare, "rep long, other long, weight long"), "vector-links")
    weights = found.filter("other is null").groupBy("rep").agg(F.sum("weight").alias("weight"))
    components = connected_components(found.filter("other is not null").select("rep", "other"), "vectors")
    per_class = classes.select("k1", "k2", "rep", "size").join(weights, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select(
        "k1", "k2",
        (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    return rows.join(per_class, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id"))).alias("kept"),
    )
