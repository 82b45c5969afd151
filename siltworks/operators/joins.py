"""Enrichment joins."""

from __future__ import annotations

import functools
import math
import operator
import sys

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import free_names, quoted
from siltworks.operators.categories import BROADCAST_BYTES
from siltworks.session import materialize, written_bytes

HOWS = ("inner", "left", "right", "full")
# Spark's joins that compare every row with every other.
ALL_PAIRS = ("BroadcastNestedLoopJoin", "CartesianProduct")
#: Keys that a frequency sketch reports at the most.
HOT_KEYS = 256
#: Rows of a block in a join by inequalities: two blocks are compared row by row in one task.
BLOCK_ROWS = 1 << 14
#: Rows of a block, of the left and of the right table, that are sent and compared with others as one array. Spark holds
#: the pairs of two arrays at once; the right rows of an array repeat for each left row.
RUN_ROWS = {"t": 64, "r": 512}
#: Tasks for a pair of blocks, so that few of them get several pairs, and the comparisons that are worth a task.
TASKS_PER_BLOCK, TASK_PAIRS = 4, 1 << 22
#: Places along one column at the most, a power of two; more rows than that make more than one block of a place.
MAX_BUCKETS = 4096
#: Comparisons of two rows that cost as much as one more row to shuffle and to sort.
PAIRS_PER_ROW = 4096


def _pairs(on: str | list) -> list[tuple[str, str]]:
    entries = [on] if isinstance(on, str) else list(on)
    return [(e, e) if isinstance(e, str) else tuple(e) for e in entries]


def _right_names(t: DataFrame, r: DataFrame, prefix: str) -> DataFrame:
    """Rename the right columns that the left table also has."""
    taken = set(t.columns)
    return r.toDF(*[f"{prefix}{c}" if c in taken else c for c in r.columns])


def enrich(
    t: DataFrame,
    r: DataFrame,
    on: str | list | Column,
    how: str = "left",
    prefix: str = "r_",
    all_pairs: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All columns of ``t`` and of ``r``; clashing right names get a prefix.

    ``on`` is a column name, a list of names or (left, right) pairs, or a
    condition over the aliases ``t`` and ``r``. A condition without an equality
    between the two would compare all pairs of rows: it is refused unless
    ``all_pairs`` asks for that. For bands use :func:`enrich_band`.

    Right and full joins on keys read each input once and write it to the shared
    folder. A right table of up to ``broadcast_bytes`` is broadcast, and its rows
    without a partner are added. Otherwise the rows of hot keys are spread over
    many tasks (:func:`_spread_join`), as a plain join of these kinds never does.
    Streams are joined plainly.
    """
    how = how.lower().replace("_outer", "").replace(" outer", "").replace("outer", "full")
    if how not in HOWS:
        raise ValueError(f"unknown join type {how!r}, use one of {HOWS}")
    if isinstance(on, Column):
        joined = t.alias("t").join(r.alias("r"), on, how)
        if not all_pairs and _nested_joins(joined) > _nested_joins(t) + _nested_joins(r):
            raise ValueError("no equality to join by: use enrich_band for low <= value <= high, enrich_bounds for other inequalities, or ask for all_pairs=True")
        renamed = _right_names(t, r, prefix).columns
        return joined.select("t.*", *[F.col(f"r.{quoted(c)}").alias(n) for c, n in zip(r.columns, renamed)])
    pairs = _pairs(on)
    renamed = _right_names(t, r, prefix)
    names = dict(zip(r.columns, renamed.columns))
    condition = [F.col(quoted(a)) == F.col(quoted(names[b])) for a, b in pairs]
    if how in ("inner", "left"):
        return t.join(renamed, condition, how)
    if t.isStreaming or r.isStreaming:
        return t.join(renamed, condition, how)
    t, r = materialize(t, "join-left"), materialize(renamed, "join-right")
    pairs = [(a, names[b]) for a, b in pairs]
    if written_bytes(r) <= broadcast_bytes and _value_bytes(r) <= broadcast_bytes:
        return _broadcast_outer(t, r, pairs, how)
    return _spread_join(t, r, pairs, how)


def _value_bytes(df: DataFrame) -> int:
    """The bytes of all values; repeated texts, which a file holds once, count each time."""
    sizes = [F.lit(16)]
    for field in df.schema.fields:
        c = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            sizes.append(F.lit(16))
    return df.agg(F.sum(sum(sizes[1:], sizes[0]).cast("bigint")).alias("size")).first()["size"] or 0


def _equal(pairs: list[tuple[str, str]]) -> list[Column]:
    return [F.col(quoted(a)) == F.col(quoted(b)) for a, b in pairs]


def _broadcast_outer(t: DataFrame, r: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    """Right or full join with a small right table. Only the keys of the left table are read again."""
    matched = t.join(F.broadcast(r), _equal(pairs), "inner" if how == "right" else "left")
    helpers = free_names([*t.columns, *r.columns], *[f"_k{i}" for i in range(len(pairs))])
    own = [(a, h) for h, (a, _) in zip(helpers, pairs)]
    other = [(h, b) for h, (_, b) in zip(helpers, pairs)]
    wanted = r.select(*[F.col(quoted(b)).alias(h) for h, b in other]).distinct()
    # No more keys than the right table has.
    found = t.select(*[quoted(a) for a, _ in pairs]).join(F.broadcast(wanted), _equal(own), "left_semi").distinct()
    found = found.toDF(*helpers)
    unmatched = r.join(found, _equal(other), "left_anti")
    empty_left = [F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema.fields]
    return matched.unionByName(unmatched.select(*empty_left, *[F.col(quoted(c)) for c in r.columns]))


def _key_tag(df: DataFrame, names: list[str], other: DataFrame, other_names: list[str]) -> Column | None:
    """A 128-bit text that equal keys of both tables share; None if their types are compared by another cast than this one."""
    keys = []
    for a, b in zip(names, other_names):
        own, its = df.schema[a].dataType, other.schema[b].dataType
        if own != its and not (isinstance(own, T.NumericType) and isinstance(its, T.NumericType)):
            return None
        keys.append(F.coalesce(F.col(quoted(a)), F.lit(None).cast(its)))
    return F.concat_ws(":", F.xxhash64(*keys), F.xxhash64(F.lit("second"), *keys))


def _hot_keys(df: DataFrame, tag: Column, missing: Column, pieces: int) -> dict[str, int]:
    """Tags of keys that hold more rows than an even piece of the table, by a frequency sketch of fixed size.

    All of them do occur. A key that the sketch leaves out holds less than 1 / HOT_KEYS of the rows.
    """
    kept = df.select(F.when(~missing, tag).alias("tag"))
    found = kept.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(tag, {HOT_KEYS}, 16384)").alias("top")).first()
    return {x["item"]: x["count"] for x in found["top"] or [] if x["item"] is not None and x["count"] * pieces > found["rows"]}


def _spread_join(t: DataFrame, r: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    """Right or full join in which no key has to fit a task.

    Rows of a key that is hot on one side get a random number below the number
    of tasks; the rows of that key on the other side are repeated for each
    number. A hot key is known to occur on its side, so a repeated row has a
    partner under some number: its unmatched repetitions are dropped. Rows
    with a missing key match nothing and are spread without being repeated.
    """
    spread, again, has_left, r_spread, r_again, has_right = free_names(
        [*t.columns, *r.columns], "_spread", "_again", "_left", "_r_spread", "_r_again", "_right"
    )
    lefts, rights = [a for a, _ in pairs], [b for _, b in pairs]
    tag, r_tag = _key_tag(t, lefts, r, rights), _key_tag(r, rights, t, lefts)
    if tag is None or r_tag is None:
        return t.join(r, _equal(pairs), how)
    pieces = max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    missing, r_missing = (F.greatest(*[F.col(quoted(c)).isNull() for c in (*own, own[0])]) for own in (lefts, rights))
    hot = _hot_keys(t, tag, missing, pieces)
    r_hot = {k: n for k, n in _hot_keys(r, r_tag, r_missing, pieces).items() if k not in hot}

    def placed(df, own_tag, is_missing, own, others, number, repeated, mark):
        # A seeded number depends on the file and the place alone, and both are written.
        alone = F.array(F.floor(F.rand(11) * pieces).cast("int"))
        is_own, is_other = own_tag.isin(list(own)), own_tag.isin(list(others))
        numbers = F.when(is_missing | is_own, alone).when(is_other, F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
        return df.select("*", F.lit(True).alias(mark), (~is_missing & is_other).alias(repeated), F.explode(numbers).alias(number))

    left = placed(t, tag, missing, hot, r_hot, spread, again, has_left)
    right = placed(r, r_tag, r_missing, r_hot, hot, r_spread, r_again, has_right)
    joined = left.join(right, [*_equal(pairs), F.col(spread) == F.col(r_spread)], how)
    partnerless = (F.col(has_left).isNull() & F.col(r_again)) | (F.col(has_right).isNull() & F.col(again))
    return joined.filter(~F.coalesce(partnerless, F.lit(False))).drop(spread, again, has_left, r_spread, r_again, has_right)


def _nested_joins(df: DataFrame) -> int:
    """How many joins of all pairs the plan holds; nothing is run."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return sum(plan.count(name) for name in ALL_PAIRS)


def enrich_band(
    t: DataFrame,
    r: DataFrame,
    value: str,
    low: str,
    high: str,
    how: str = "inner",
    prefix: str = "r_",
    high_inclusive: bool = True,
) -> DataFrame:
    """Join rows to the bands of ``r`` with ``low <= value <= high``, exactly.

    Such a condition has no key, so Spark would compare every row with every
    band. Here each band belongs to a level, the power of two that is at least
    its width, and covers two cells of that size at the most, or the four a
    band without ends has; a row is looked up in
    its one cell per level in use. That gives an ordinary join on (level, cell)
    with the true condition on top.
    """
    if how not in ("inner", "left"):
        raise ValueError("enrich_band joins 'inner' or 'left'")
    renamed = _right_names(t, r, prefix)
    names = dict(zip(r.columns, renamed.columns))
    lo, hi = (F.col(quoted(names[n])).cast("double") for n in (low, high))
    magnitude = F.greatest(F.abs(_finite(lo)), F.abs(_finite(hi)))
    # A band of no width still gets a cell wide enough to be numbered exactly.
    size = F.greatest(_finite(hi - lo), magnitude * 2.0**-40, F.lit(2.0**-900))
    level = F.ceil(F.least(F.log2(size) + 1e-9, F.lit(1023.0))).cast("int")
    spot, level_name, cell, row_name = free_names([*t.columns, *renamed.columns], "_spot", "_level", "_cell", "_row")
    bands = renamed.filter(lo <= hi).withColumn(level_name, level)
    # One number per power of two in use.
    levels = sorted(found[level_name] for found in bands.select(level_name).distinct().collect())
    if not levels:
        return t.join(bands.drop(level_name), F.lit(False), how)
    width = F.pow(F.lit(2.0), F.col(level_name))
    cells = F.sequence(F.floor(_finite(lo) / width), F.floor(_finite(hi) / width))
    placed = bands.withColumn(cell, F.explode(cells))
    v = F.col(quoted(value)).cast("double")
    spots = F.array(*[
        F.struct(F.lit(k).alias("l"), F.floor(_finite(v) / F.lit(math.ldexp(1.0, k))).alias("c")) for k in levels
    ])
    below = (v <= hi) if high_inclusive else (v < hi)
    match = [F.col(f"{spot}.l") == F.col(level_name), F.col(f"{spot}.c") == F.col(cell), v >= lo, below]
    helpers = (spot, level_name, cell, row_name)
    if how == "inner" or len(levels) == 1:
        return t.withColumn(spot, F.explode(spots)).join(placed, match, how).drop(*helpers)
    # Several lookups per row: numbers, fixed by writing them, tell the rows that matched nowhere.
    numbered = materialize(t.withColumn(row_name, F.monotonically_increasing_id()), "numbered")
    joined = numbered.withColumn(spot, F.explode(spots)).join(placed, match, "inner")
    alone = numbered.join(joined.select(row_name).distinct(), row_name, "left_anti")
    return joined.drop(*helpers).unionByName(alone.drop(row_name), allowMissingColumns=True)


def _finite(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))


def _number(df: DataFrame, name: str) -> Column:
    """A column as a double that keeps its order."""
    kind = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"{name!r} is neither a number nor a date or a time")


def enrich_bounds(
    t: DataFrame,
    r: DataFrame,
    bounds: list[tuple[str, str, str]],
    how: str = "inner",
    prefix: str = "r_",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Join by inequalities (left column, one of < <= > >=, right column), all of which must hold.

    The first two order both tables into a grid of places; a place knows the
    least and the greatest values of its rows. Only pairs of places whose values
    may fulfil the conditions are joined, by their number, and a place is cut into
    blocks of ``block_rows`` rows: a task compares blocks, never a whole table.
    A row is shuffled once for each block it meets, so a finer grid compares fewer
    rows and shuffles more; :func:`_places` refines it as long as that pays.
    Of conditions that many pairs fulfil about two rows are then shuffled for
    ``block_rows`` pairs. The rows of a block are sent in arrays of ``RUN_ROWS`` neighbours by the
    conditions (:func:`_runs`); arrays whose ends rule a match out are not compared.
    The pairs of two arrays come out together, so the values of both sides repeat
    and a columnar file of the result takes a fraction of the space that pairs in any order take.
    Null values match nothing. The columns of a condition are numbers, or both dates, or both times.
    """
    if how not in ("inner", "left"):
        raise ValueError("enrich_bounds joins 'inner' or 'left'")
    if not bounds or any(op not in ("<", "<=", ">", ">=") for _, op, _ in bounds):
        raise ValueError("bounds are (left column, '<', '<=', '>' or '>=', right column)")
    for a, _, b in bounds:
        kinds = [df.schema[n].dataType for df, n in ((t, a), (r, b))]
        _number(t, a), _number(r, b)
        if kinds[0] != kinds[1] and not all(isinstance(k, T.NumericType) for k in kinds):
            raise ValueError(f"{a!r} and {b!r} are of different types")
    renamed = _right_names(t, r, prefix)
    names = dict(zip(r.columns, renamed.columns))
    bounds = [(a, op, names[b]) for a, op, b in bounds]
    end_names = [f"{side}end{i}" for side in "tr" for i in range(len(bounds))]
    wanted_names = ("t0", "t1", "r0", "r1", "tspot", "rspot", "met", "piece", "run", "other", "trun", "rrun", "tblock", "rblock", *end_names)
    row, *helpers = free_names([*t.columns, *renamed.columns], "_row", *[f"_{k}" for k in wanted_names])
    h = dict(zip(wanted_names, helpers))
    kept = materialize(t.withColumn(row, F.monotonically_increasing_id()), "bounds-left") if how == "left" else t
    # One dimension for each of the first two conditions.
    dims = bounds[:2]
    some_t = kept.filter(" and ".join(f"{quoted(a)} is not null" for a, _, _ in bounds))
    some_r = renamed.filter(" and ".join(f"{quoted(b)} is not null" for _, _, b in bounds))
    splits = _grid([_number(t, a) for a, _, _ in dims], some_t, block_rows)
    placed = []
    for side, df, columns in (("t", some_t, [a for a, _, _ in dims]), ("r", some_r, [b for _, _, b in dims])):
        for i, name in enumerate(columns):
            df = df.withColumn(h[f"{side}spot"], _number(df, name))
            cut = Bucketizer(splits=splits[i], inputCol=h[f"{side}spot"], outputCol=h[f"{side}{i}"], handleInvalid="keep")
            df = cut.transform(df).withColumn(h[f"{side}{i}"], F.col(h[f"{side}{i}"]).cast("int"))
        df = df if len(dims) == 2 else df.withColumn(h[f"{side}1"], F.lit(0))
        placed.append(materialize(df.withColumn(h[f"{side}spot"], F.rand(13)), f"bounds-{side}"))
    cells = []
    for side, df, columns in (("t", placed[0], [a for a, _, _ in dims]), ("r", placed[1], [b for _, _, b in dims])):
        ends = [f(_number(df, c)).alias(f"{side}{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
        own = df.groupBy(F.col(h[f"{side}0"]).alias(f"{side}0"), F.col(h[f"{side}1"]).alias(f"{side}1"))
        cells.append(materialize(own.agg(*ends, F.count(F.lit(1)).alias(f"{side}rows")), "bounds-cells"))
    met, shift = _places(*cells, [op for _, op, _ in dims], max(map(len, splits)) - 1, block_rows)
    placed = [df.withColumns({h[f"{s}{i}"]: F.shiftright(h[f"{s}{i}"], shift) for i in (0, 1)}) for s, df in zip("tr", placed)]

    met_blocks = met.agg(F.sum(F.col("tn").cast("bigint") * F.col("rn"))).first()[0] or 1
    tasks = min(TASKS_PER_BLOCK * met_blocks, math.ceil(met_blocks * block_rows**2 / TASK_PAIRS), MAX_BUCKETS)
    sides = {"t": [a for a, _, _ in bounds], "r": [b for _, _, b in bounds]}

    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        counts = met.select(*[F.col(f"{own}{i}").alias(h[f"{own}{i}"]) for i in (0, 1)], F.col(f"{own}n").alias(h["met"])).distinct()
        place = [h[f"{own}{i}"] for i in (0, 1)]
        mine = df.join(counts, place).withColumn(h["piece"], F.floor(F.col(h[f"{own}spot"]) * F.col(h["met"])).cast("int"))
        # A row is easiest to match, from this side, at the end that the other side has to pass.
        up = [(op in (">", ">=")) == (own == "r") for _, op, _ in bounds]
        own_ends = [h[f"{own}end{i}"] for i in range(len(bounds))]
        columns = [quoted(c) for c in df.columns if c not in helpers]
        runs = _runs(mine, [*place, h["piece"]], columns, list(zip(sides[own], up, own_ends)), len(dims), RUN_ROWS[own], h["run"], h[f"{own}run"])
        pairs = met.select(F.struct(*met.columns).alias(h["met"]))
        m = {c: F.col(f"{h['met']}.{c}") for c in met.columns}
        at_place = runs.join(pairs, [F.col(h[f"{own}{i}"]) == m[f"{own}{i}"] for i in (0, 1)])
        cut = at_place.withColumn(h["other"], F.explode(F.sequence(F.lit(0), m[f"{other}n"] - 1)))
        numbers = {c: m[c] for c in ("t0", "t1", "r0", "r1")} | {own: F.col(h["piece"]), other: F.col(h["other"])}
        # Never null, as in the other table: else the keys are cast to be compared, and sent once more.
        block = F.struct(*[F.coalesce(numbers[c], F.lit(0)).alias(c) for c in ("t0", "t1", "r0", "r1", "t", "r")])
        # Little is sent for many pairs: the number of tasks is not left to the bytes.
        return cut.select(h[f"{own}run"], *own_ends, block.alias(h[f"{own}block"])).repartition(tasks, h[f"{own}block"])

    holds = [F.expr(f"{quoted(a)} {op} {quoted(b)}") for a, op, b in bounds]
    may_hold = [F.expr(f"{h[f'tend{i}']} {op} {h[f'rend{i}']}") for i, (_, op, _) in enumerate(bounds)]
    # Rows are repeated by block, which size estimates do not see: no side is broadcast.
    left, right = blocks(placed[0], "t", "r"), blocks(placed[1], "r", "t").hint("merge")
    runs = left.join(right, [F.col(h["tblock"]) == F.col(h["rblock"]), *may_hold]).select(h["trun"], h["rrun"])
    each = runs.select(F.explode(h["trun"]).alias(h["tspot"]), h["rrun"]).select(h["tspot"], F.explode(h["rrun"]).alias(h["rspot"]))
    joined = each.select(f"{h['tspot']}.*", f"{h['rspot']}.*").filter(functools.reduce(operator.and_, holds))
    if how == "inner":
        return joined

    def has_partner(x: Column) -> Column:
        compare = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
        return F.exists(h["rrun"], lambda y: functools.reduce(operator.and_, [compare[op](x[a], y[b]) for a, op, b in bounds]))

    # A row is asked for its first partner only; the pairs are not made again.
    partnered = runs.select(F.explode(F.transform(F.filter(h["trun"], has_partner), lambda x: x[row])).alias(row)).distinct()
    alone = kept.join(partnered, row, "left_anti")
    return joined.drop(row).unionByName(alone.drop(row), allowMissingColumns=True)


def _runs(
    df: DataFrame, block: list[str], columns: list[str], ends: list[tuple[str, bool, str]], dims: int, run_rows: int, number: str, run: str
) -> DataFrame:
    """The rows of each block in arrays of up to ``run_rows``, each with its easiest value by every condition.

    ``ends`` has the column of each condition, whether lower values are easier to match, and the name of
    the easiest value. Rows are cut into arrays by the second condition, then the
    first, and lie in them by the first, easiest first: neighbours have much the same partners.
    """
    towards = [F.col(quoted(c)).asc() if up else F.col(quoted(c)).desc() for c, up, _ in ends[:dims]]
    place = F.row_number().over(Window.partitionBy(*block).orderBy(*reversed(towards)))
    first, up, _ = ends[0]

    def easier(x: Column, y: Column) -> Column:
        one, other = (x[first], y[first]) if up else (y[first], x[first])
        return F.when(one < other, -1).when(one > other, 1).otherwise(0)

    kept = F.array_sort(F.collect_list(F.struct(*columns)), easier).alias(run)
    easiest = [(F.min if up else F.max)(quoted(c)).alias(name) for c, up, name in ends]
    return df.withColumn(number, F.floor((place - 1) / F.lit(run_rows))).groupBy(*block, number).agg(kept, *easiest)


def _places(t: DataFrame, r: DataFrame, ops: list[str], last: int, block_rows: int) -> tuple[DataFrame, int]:
    """The pairs of places that may have partners, and how many times the places were halved along each column.

    ``t`` and ``r`` are the finest places, numbered from 0 to ``last`` along a
    column. From one place for all rows on, places are halved along each column while the comparisons saved
    outweigh the rows that have to be sent to more places.
    """

    def halved(df: DataFrame, side: str, shift: int) -> DataFrame:
        numbers = [F.shiftright(f"{side}{i}", shift).alias(f"{side}{i}") for i in (0, 1)]
        ends = [f(f"{side}{n}{i}").alias(f"{side}{n}{i}") for i in range(len(ops)) for n, f in (("lo", F.min), ("hi", F.max))]
        own = df.groupBy(*numbers).agg(*ends, F.sum(f"{side}rows").alias(f"{side}rows"))
        return own.withColumn(f"{side}n", F.ceil(F.col(f"{side}rows") / F.lit(block_rows)).cast("int"))

    def met(shift: int) -> DataFrame:
        # Places that a right place can meet along the first column, then the ends of both.
        reach = F.sequence(F.lit(0), F.col("r0")) if ops[0] in ("<", "<=") else F.sequence(F.col("r0"), F.lit(last >> shift))
        possible = [
            F.col(f"tlo{i}") <= F.col(f"rhi{i}") if op in ("<", "<=") else F.col(f"thi{i}") >= F.col(f"rlo{i}") for i, op in enumerate(ops)
        ]
        right = halved(r, "r", shift).withColumn("m0", F.explode(reach))
        return right.join(halved(t, "t", shift), [F.col("m0") == F.col("t0"), *possible])

    def cost(shift: int) -> float:
        pairs = F.col("trows").cast("double") * F.col("rrows")
        sent = F.col("trows") * F.col("rn") + F.col("rrows") * F.col("tn")
        return met(shift).agg(F.sum(pairs + sent * PAIRS_PER_ROW)).first()[0] or 0.0

    shift = last.bit_length()
    least = cost(shift)
    # Every row of a place is sent once at the least.
    sizes = [df.agg(F.sum(f"{s}rows")).first()[0] or 0 for df, s in ((t, "t"), (r, "r"))]
    while shift and least > PAIRS_PER_ROW * sum(sizes) * 2 and (finer := cost(shift - 1)) < least:
        shift, least = shift - 1, finer
    return materialize(met(shift).select("t0", "t1", "r0", "r1", "tn", "rn"), "bounds-places"), shift


def _grid(columns: list[Column], df: DataFrame, block_rows: int) -> list[list[float]]:
    """Ends of the finest places along each column: quantiles, so that places hold like numbers of rows."""
    total = df.count()
    buckets = int(min(max(math.ceil(total / block_rows), 1), MAX_BUCKETS))
    shares = [i / buckets for i in range(1, buckets)]
    found = [[]] * len(columns)
    if shares:
        asked = [F.percentile_approx(c, shares, F.lit(8 * buckets)).alias(f"q{i}") for i, c in enumerate(columns)]
        found = [q or [] for q in df.agg(*asked).first()]
    inner = [sorted({x for x in q if math.isfinite(x)}) for q in found]
    return [[-math.inf, *(ends or [0.0]), math.inf] for ends in inner]
