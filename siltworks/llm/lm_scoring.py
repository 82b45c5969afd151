"""Language-model scoring by context-tree weighting over bytes.

A text is its words, each with a stop byte, and an end byte. Every byte is eight
binary decisions. A decision's contexts are the last bytes of the text, from none
up to ``depth``, across words; every context keeps counts of zeros and ones,
estimates by Krichevsky and Trofimov, and is weighted against the contexts that
extend it by how well either side explains the training texts. The code length
of a byte mixes the estimates of all depths by these weights.

What is gathered is a table with one row for each gram, a byte in its longest
context. All contexts that share their last ``depth`` - 2 bytes make a subtree of
at most 2^24 grams, which lies in one partition: subtrees are weighted there in
arrays, the small tree above them by grouping and joining, from the deepest level
up and then from the root down. Texts look up their grams and tokens, frequent
ones in tables of bounded size that travel with the tasks, all others by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import CACHE_ENTRIES, Batches, arrow_type, parked, scan, texts_of, words_of

#: Spelling: neither byte can occur in a word.
END, STOP = b"\t", b" "
#: Most rows of the tables of frequent tokens and of frequent grams that tasks hold.
HEAD_TOKENS = 1 << 17
HEAD_GRAMS = 1 << 21
#: Bytes of text whose grams are made at once, grams a task counts before it sends them, grams whose subtrees are weighted at once.
PIECE_BYTES = 1 << 20
COUNTED_GRAMS = 3 << 20
STEP_GRAMS = 1 << 17
#: Grams of a batch that a task sends: the JVM holds whole batches beside its heap.
SENT_GRAMS = 1 << 16
#: Slots of the table of frequent grams, as a power of two.
SLOT_BITS = 22
#: Levels of a subtree below its root.
SUBTREE = 2

Arrays = tuple[np.ndarray, ...]


def spelled(words: list[bytes]) -> bytes:
    return STOP.join([*words, END])


def _vocabulary(docs: DataFrame) -> DataFrame:
    """(token, n): every token of the corpus with its training count, 0 where only held-out texts have it."""

    def run(batches: Batches) -> Batches:
        out = arrow_type("token binary, n long")
        counts: Counter[bytes] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((list(counts), list(counts.values())), out, strict=True)], schema=out)

        for batch in batches:
            for held, text in zip(batch.column("held_out").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                words.append(END)
                if held:
                    for word in set(words):
                        counts.setdefault(word, 0)
                else:
                    counts.update(words)
                if len(counts) > CACHE_ENTRIES:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    found = scan(docs, {c: c for c in ("held_out", "text")}, run, "token binary, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def _bits(n: int) -> int:
    """A mask of the ``n`` low bits of a 64-bit number."""
    return -1 if n >= 64 else (1 << n) - 1


def grams_of(spellings: list[bytes], depth: int, piece_bytes: int = PIECE_BYTES) -> Iterator[Arrays]:
    """(owner, key) of every byte of the spelled texts, by pieces of bounded size.

    A key holds the ``depth`` bytes before a byte and, lowest, the byte; before a
    text there are zeros. Long texts are cut, each part with the bytes before it.
    """

    def keys(group: list[tuple[int, bytes]]) -> Arrays:
        lengths = np.array([len(part) for _, part in group])
        data = np.frombuffer(b"".join(part for _, part in group), np.uint8).astype(np.int64)
        key = data[depth:].copy()
        for back in range(1, depth + 1):
            key |= data[depth - back : len(data) - back] << (8 * back)
        own = np.ones(len(data), bool)
        own[np.add.outer(np.cumsum(lengths) - lengths, np.arange(depth)).ravel()] = False
        return np.repeat([owner for owner, _ in group], lengths - depth), key[own[depth:]]

    group, size = [], 0
    for owner, text in enumerate(spellings):
        for at in range(0, len(text), piece_bytes):
            before = text[max(at - depth, 0) : at].rjust(depth, b"\0")
            group.append((owner, before + text[at : at + piece_bytes]))
            size += len(group[-1][1])
            if size >= piece_bytes:
                yield keys(group)
                group, size = [], 0
    if group:
        yield keys(group)


def _summed(parts: list[Arrays]) -> Arrays:
    """Keys in order, each once, with the sums of what stands beside them. The list is emptied, so that no column is held twice."""
    columns = [list(c) for c in zip(*parts, strict=True)]
    parts.clear()

    def taken() -> np.ndarray:
        return np.concatenate(columns.pop(0))

    keys = taken()
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
    keys = keys[start]
    sums = []
    while columns:
        sums.append(np.add.reduceat(taken()[order], start))
    return keys, *sums


def _sent(columns: Arrays, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns as batches of bounded size."""
    whole = pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)
    yield from (whole.slice(at, SENT_GRAMS) for at in range(0, len(whole), SENT_GRAMS))


def _grams(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n, seen): all grams of the corpus with their counts in training and in all, summed by task only."""

    def run(batches: Batches) -> Batches:
        names = ["gram", "n", "seen"]
        parts, size = [], 0
        for batch in batches:
            held = np.array(batch.column("held_out").to_pylist(), bool)
            for owner, key in grams_of([spelled(words_of(t)) for t in texts_of(batch)], depth):
                for own, trained in ((key[~held[owner]], 1), (key[held[owner]], 0)):
                    grams, seen = np.unique(own, return_counts=True)
                    parts.append((grams, seen * trained, seen))
                    size += len(grams)
                if size > COUNTED_GRAMS:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size > COUNTED_GRAMS // 2:
                        yield from _sent(parts.pop(), names)
                        size = 0
        if size:
            yield from _sent(_summed(parts), names)

    return scan(docs, {c: c for c in ("held_out", "text")}, run, "gram long, n long, seen long")


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0 by Stirling's series, seven places up."""
    product = x
    for i in range(1, 7):
        product = product * (x + i)
    z = x + 7
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - F.log(product)


def log_kt(zeros: Column, ones: Column) -> Column:
    """ln of the probability that the estimator gives a sequence of these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """As :func:`log_kt`, in arrays."""

    def log_gamma(x):
        product = x.copy()
        for i in range(1, 7):
            product *= x + i
        z = x + 7
        return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)

    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


class _Subtrees:
    """The levels from ``top`` to ``depth`` over whole subtrees, as arrays by level and by bit of the byte.

    A node is the cut context and the first ``i`` bits of the byte, one number.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.keys, self.depth, self.top = keys, depth, top
        self.node, self.zeros, self.ones, self.weighted, self.stop, self.parent = ({} for _ in range(6))
        half = math.log(0.5)
        for d in range(top, depth + 1):
            cut, count = _summed([(keys & _bits(8 * d + 8), n.astype(np.float64))])
            for i in range(8):
                node, bit = cut >> (8 - i), (cut >> (7 - i)) & 1
                start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                self.node[d, i] = node[start]
                self.zeros[d, i], self.ones[d, i] = np.add.reduceat(count * (1 - bit), start), np.add.reduceat(count * bit, start)
                if d > top:
                    self.parent[d, i] = np.searchsorted(self.node[d - 1, i], node[start] & _bits(8 * (d - 1) + i))
        for i in range(8):
            for d in range(depth, top - 1, -1):
                own = _log_kt(self.zeros[d, i], self.ones[d, i])
                if d == depth:
                    self.weighted[d, i], self.stop[d, i] = own, np.ones(len(own))
                    continue
                split = np.bincount(self.parent[d + 1, i], self.weighted[d + 1, i], len(own))
                self.weighted[d, i] = np.logaddexp(own + half, split + half)
                self.stop[d, i] = np.exp(own + half - self.weighted[d, i])

    def top_nodes(self, i: int) -> np.ndarray:
        """Nodes of the level ``top`` as tables name them: context above, binary node in the low byte."""
        node = self.node[self.top, i]
        return (node >> i) << 8 | 1 << i | node & _bits(i)

    def roots(self) -> Arrays:
        """(node, zeros, ones, weighted, stop) of the level ``top``."""
        by_bit = [(self.top_nodes(i), *(of[self.top, i] for of in (self.zeros, self.ones, self.weighted, self.stop))) for i in range(8)]
        return tuple(map(np.concatenate, zip(*by_bit, strict=True)))

    def scores(self, nodes: np.ndarray, one: np.ndarray, total: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the probability of every gram, from the predictions of the level ``top``, in order of ``nodes``."""
        score = np.zeros(len(self.keys))
        for i in range(8):
            at = np.searchsorted(nodes, self.top_nodes(i))
            own, so_far, rest = one[at], total[at], left[at]
            for d in range(self.top + 1, self.depth + 1):
                up, zeros, ones, stop = self.parent[d, i], self.zeros[d, i], self.ones[d, i], self.stop[d, i]
                estimate = (ones + 0.5) / (zeros + ones + 1)
                own = np.where(zeros + ones > 0, so_far[up] + rest[up] * estimate, own[up])
                so_far, rest = so_far[up] + rest[up] * stop * estimate, rest[up] * (1 - stop)
            own = own[np.searchsorted(self.node[self.depth, i], self.keys >> (8 - i))]
            score += np.log10(np.where((self.keys >> (7 - i)) & 1 == 1, own, 1 - own))
        return score


def _steps(keys: np.ndarray, top: int, most: int = STEP_GRAMS) -> Iterator[np.ndarray]:
    """Places of the keys in steps of about ``most``, subtrees whole."""
    roots = (keys >> 8) & _bits(8 * top)
    order = np.argsort(roots, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(roots[order]) != 0, len(keys) > 0]) + 1
    at = 0
    while at < len(keys):
        end = ends[min(np.searchsorted(ends, at + most), len(ends) - 1)]
        yield order[at:end]
        at = end


def _context(key: Column, depth: int) -> Column:
    """A node (context above, binary node in the low byte) with the context cut to ``depth`` bytes."""
    return key.bitwiseAND(F.lit((1 << (8 * depth + 8)) - 1))


def _levels(level: DataFrame, top: int) -> list[DataFrame]:
    """The tree from the root's level to the level ``top``, which is given: node, counts and the weight of stopping there."""
    half = math.log(0.5)
    levels = [level]
    for d in reversed(range(top)):
        up = levels[-1].groupBy(_context(F.col("node"), d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("split"))
        stop, split = log_kt(F.col("zeros"), F.col("ones")) + half, F.col("split") + half
        most = F.greatest("log_stop", "log_split")
        up = up.withColumn("log_stop", stop).withColumn("log_split", split)
        up = up.withColumn("weighted", most + F.log(F.exp(F.col("log_stop") - most) + F.exp(F.col("log_split") - most)))
        up = up.withColumn("stop", F.exp(F.col("log_stop") - F.col("weighted")))
        levels.append(parked(up.select("node", "zeros", "ones", "weighted", "stop"), f"tree-{d}"))
    return levels[::-1]


def _predictions(levels: list[DataFrame]) -> DataFrame:
    """(node, one, sum, left) of the deepest level given: the mixed probability of a one, and what deeper levels go on with.

    A context that training never met adds nothing; the mixture then ends at the
    longest one it did meet.
    """
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    met = F.col("zeros") + F.col("ones") > 0
    mixed = levels[0].select(
        "node", estimate.alias("one"), (F.col("stop") * estimate).alias("sum"), (1 - F.col("stop")).alias("left")
    )
    for d, level in enumerate(levels[1:], start=1):
        above = mixed.select(F.col("node").alias("above"), F.col("one").alias("one_above"), F.col("sum").alias("sum_above"), F.col("left").alias("left_above"))
        joined = level.join(above, _context(F.col("node"), d - 1) == F.col("above"))
        mixed = joined.select(
            "node",
            F.when(met, F.col("sum_above") + F.col("left_above") * estimate).otherwise(F.col("one_above")).alias("one"),
            (F.col("sum_above") + F.col("left_above") * F.col("stop") * estimate).alias("sum"),
            (F.col("left_above") * (1 - F.col("stop"))).alias("left"),
        )
    return mixed


def _columns(batches: Batches, names: list[str]) -> list[np.ndarray]:
    """Whole columns of a partition."""
    held = [[b.column(n).to_numpy() for n in names] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*held, strict=True)]


def _gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, seen, score): log10 of the probability of a byte in its context.

    Grams are summed where their subtree is weighted. What that finds is written
    as one table: grams with their counts, and the subtrees' roots (``seen`` -1).
    """
    top = max(depth - SUBTREE, 0)

    def by_subtree(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.shiftright("key", 8).bitwiseAND(F.lit(_bits(8 * top))))

    up_schema = "key long, n long, seen long, zeros double, ones double, weighted double, stop double"

    def up(batches: Batches) -> Batches:
        out = arrow_type(up_schema)

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        columns = _columns(batches, ["key", "n", "seen"])
        if columns:
            keys, n, seen = _summed([tuple(columns)])
            for own in _steps(keys, top):
                none = np.zeros(len(own))
                yield rows(keys[own], n[own], seen[own], none, none, none, none)
                node, *found = _Subtrees(keys[own], n[own], depth, top).roots()
                yield rows(node, np.zeros(len(node), np.int64), np.full(len(node), -1), *found)

    def down(batches: Batches) -> Batches:
        out = arrow_type("gram long, seen long, score double")
        columns = _columns(batches, ["key", "n", "seen", "one", "sum", "left"])
        if not columns:
            return
        is_node = columns[2] < 0
        nodes, *predicted = (columns[c][is_node] for c in (0, 3, 4, 5))
        order = np.argsort(nodes)
        nodes, predicted = nodes[order], [p[order] for p in predicted]
        keys, n, seen = (c[~is_node] for c in columns[:3])
        order = np.argsort(keys)
        keys, n, seen = keys[order], n[order], seen[order]
        for own in _steps(keys, top):
            scores = _Subtrees(keys[own], n[own], depth, top).scores(nodes, *predicted)
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(seen[own]), pa.array(scores)], schema=out)

    found = parked(by_subtree(grams.withColumnRenamed("gram", "key")).mapInArrow(up, up_schema), f"tree-{top}")
    level = found.filter("seen < 0").select(F.col("key").alias("node"), "zeros", "ones", "weighted", "stop")
    predicted = _predictions(_levels(level, top))
    none = F.lit(0.0)
    both = found.filter("seen >= 0").select("key", "n", "seen", none.alias("one"), none.alias("sum"), none.alias("left")).unionByName(
        predicted.select(F.col("node").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("seen"), "one", "sum", "left")
    )
    return by_subtree(both).mapInArrow(down, "gram long, seen long, score double")


def _head(rows: DataFrame, times: str, most: int) -> DataFrame:
    """The rows of the largest ``times``, ``most`` at the most: all above a count that a histogram finds."""
    level = F.floor(8 * F.log2(F.col(times) + 1)).cast("int")
    histogram = rows.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in histogram:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return rows.filter(level >= least) if least is not None else rows.limit(0)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.int64(-7046029254386353131)) >> (64 - SLOT_BITS) & _bits(SLOT_BITS)


def _frequent(keys: np.ndarray, seen: np.ndarray, scores: np.ndarray) -> Arrays:
    """Keys in order, their scores, and for each slot the place of the most frequent key of that hash."""
    order = np.argsort(keys)
    keys, scores = keys[order], scores[order]
    slots = np.zeros(1 << SLOT_BITS, np.int32)
    rising = np.argsort(seen[order], kind="stable")
    slots[_slot(keys[rising])] = rising
    return keys, scores, slots


def _looked_up(table: Arrays, grams: np.ndarray) -> Arrays:
    """Whether each gram is in the table, and its score or 0: by its slot, else by bisection."""
    keys, scores, slots = table
    if not len(keys):
        return np.zeros(len(grams), bool), np.zeros(len(grams))
    at = slots[_slot(grams)]
    known, score = keys[at] == grams, scores[at]
    missed = np.flatnonzero(~known)
    at = np.minimum(np.searchsorted(keys, grams[missed]), len(keys) - 1)
    known[missed] = found = keys[at] == grams[missed]
    score[missed] = np.where(found, scores[at], 0.0)
    return known, score


def score_texts(
    docs: DataFrame,
    is_held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 6,
    head_tokens: int = HEAD_TOKENS,
    head_grams: int = HEAD_GRAMS,
) -> DataFrame:
    """Scores of every text under a model of the texts that are not held out.

    Words are lower-cased (A-Z) and split at ASCII white space; each text ends
    with one more token. ``base_score`` is the add-one unigram score over tokens,
    ``score`` the log10 probability by the context tree, ``bits_per_byte`` its code
    length by spelled byte. One row per input row; a null or empty text is its
    end alone; repeated rows are learned from as often as they come. Without any
    training text every decision is even.
    """
    if not 1 <= depth <= 7:
        raise ValueError("depth lies between 1 and 7 bytes")
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), docs[text_col].alias("text"))
    tokens = parked(_vocabulary(own), "vocabulary")
    sums = tokens.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    n_train, n_distinct = sums[0] or 0, sums[1] or 0
    gram_scores = parked(_gram_scores(_grams(own, depth), depth), "gram-scores")

    frequent = _head(tokens, "n", head_tokens).toArrow()
    index = {t: i for i, t in enumerate(frequent["token"].to_pylist())}
    frequent_grams = _head(gram_scores, "seen", head_grams).toArrow()
    held = _frequent(*(frequent_grams[c].to_numpy() for c in ("gram", "seen", "score")))
    table = spark.sparkContext.broadcast((index, frequent["n"].to_numpy(), held))
    per_token = math.log10(n_train + n_distinct + 1)
    partial = "doc_id long, row long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double"
    schema = f"{partial}, rest array<struct<token: binary, times: long>>, tree double, rest_grams array<long>"

    def run(batches: Batches) -> Batches:
        places, counts, frequent_grams = table.value
        logs = np.log10(counts + 1.0)
        kind = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))
        out = pa.schema([*arrow_type(partial), ("rest", kind), ("tree", pa.float64()), ("rest_grams", pa.list_(pa.int64()))])
        for batch in batches:
            rows, spellings = [], []
            for text in texts_of(batch):
                words = words_of(text)
                spellings.append(spelled(words))
                words.append(END)
                found = np.fromiter((places.get(w, -1) for w in words), np.int64, len(words))
                known, times = np.unique(found[found >= 0], return_counts=True)
                rest = Counter(words[i] for i in np.flatnonzero(found < 0))
                rows.append((
                    len(spellings[-1]), len(words), int(times[counts[known] > 0].sum()), float(times @ logs[known]),
                    [{"token": t, "times": n} for t, n in rest.items()],
                ))
            tree, rest_owners, rest_grams = np.zeros(len(rows)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for owner, key in grams_of(spellings, depth):
                known, score = _looked_up(frequent_grams, key)
                tree += np.bincount(owner, score, len(rows))
                rest_owners.append(owner[~known])
                rest_grams.append(key[~known])
            offsets = np.searchsorted(np.concatenate(rest_owners), np.arange(len(rows) + 1)).astype(np.int32)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("held_out")] + [pa.array(c, f.type) for c, f in zip(columns, list(out)[3:8], strict=True)]
                + [pa.array(tree), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rest_grams)))], schema=out
            )

    picked = own.withColumn("row", F.monotonically_increasing_id())
    partials = parked(scan(picked, {c: c for c in ("doc_id", "row", "held_out", "text")}, run, schema), "text-heads")
    rest = partials.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.times")
    rest = rest.join(tokens, "token").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rest_base"),
    )
    late = partials.select("row", F.explode("rest_grams").alias("gram"))
    late = late.join(gram_scores.select("gram", "score"), "gram").groupBy("row").agg(F.sum("score").alias("rest_tree"))
    zero = F.lit(0)
    total = F.col("tree") + F.coalesce("rest_tree", F.lit(0.0))
    return partials.drop("rest", "rest_grams").join(rest, "row", "left").join(late, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", zero)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero) - F.col("n_tokens") * per_token).alias("base_score"),
        total.alias("score"),
        (-total * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
