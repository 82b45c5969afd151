"""N-gram Jaccard self-join by set-relation skipping.

Index lists hold the documents whose prefix contains a shingle; the prefix is
taken in a global order by how often a shingle's bucket comes in the whole
corpus, rare ones first, so a document's entries are its first positions and
entries of buckets met once are skipped, as no other document can share them.

Lists are not joined with themselves. All documents of a list form a family
with its smallest document, the leader. The leader's answers are computed first:
its overlap with every member. A member's own answers are derived from them.
Members linked to the leader are connected and need no comparison with each
other. For any other pair of a family the overlaps with the leader bound the
pair's overlap, and blocks whose bound is too low are skipped; only what is left
is counted, block by block, and a block returns a spanning forest of its links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import Batches, WordHashes, arrow_type, give_back, parked, scan, shingles_in_order, texts_of, words_of
from siltworks.llm.components import connected_components, forest

#: The bucket table: two rows of buckets, a fixed size whatever the corpus.
BUCKET_BITS = 26
ROW_FACTORS = (1, 0xD6E8FEB86659FD93)
SLICE_BITS = 16
#: Members of a family that are compared together.
BLOCK_ROWS = 512
#: Shingles counted at once when overlaps are computed.
COLUMNS = 4096
#: Numbers that thin out documents before candidates' texts are fetched.
MARK_BITS = 20


def shingle_set(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    return np.unique(shingles_in_order(hashes.of(words_of(text)), width))


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest overlap by which a set of ``n`` links with any other."""
    return -(-percent * n // 100)


def linked(overlap: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return (100 * overlap >= percent * (n + m - overlap)) & (overlap > 0)


def buckets_of(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each shingle in each row of the table."""
    rows = [(shingles * np.uint64(f)) >> np.uint64(64 - BUCKET_BITS) | np.uint64(r << BUCKET_BITS) for r, f in enumerate(ROW_FACTORS)]
    return np.array(rows).astype(np.int64)


def order_class(counts: np.ndarray) -> np.ndarray:
    """Counts in four bits: exact up to 8, then by powers of two."""
    over = counts > 8
    out = np.minimum(counts, 8).astype(np.uint8)
    out[over] = np.minimum(15, 5 + np.ceil(np.log2(counts[over]))).astype(np.uint8)
    return out


def packed_classes(classes: np.ndarray) -> np.ndarray:
    return classes[0::2] | classes[1::2] << 4


def classes_of(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The lower of a shingle's classes: its count is at most that of its rarest bucket."""
    buckets = buckets_of(shingles)
    return (table[buckets >> 1] >> ((buckets & 1) << 2).astype(np.uint8) & 15).min(axis=0)


def prefix_of(shingles: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the global order; two linked sets share one of them. Those of single buckets are left out."""
    size = len(shingles) - int(least_overlap(len(shingles), percent)) + 1
    # By class, then by value: a stable sort of the sorted set.
    first = np.argsort(classes, kind="stable")[:size]
    return shingles[first[classes[first] > 1]]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``; sets are sorted and distinct."""
    out = np.zeros((len(a), len(b)), np.int64)
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    own_a, own_b = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    if len(a) == 1:
        hits = np.searchsorted(a[0], all_b)
        hits[hits == len(a[0])] = 0
        return np.bincount(own_b, a[0][hits] == all_b, len(b)).astype(np.int64)[None]
    shared = np.intersect1d(all_a, all_b)
    for at in range(0, len(shared), COLUMNS):
        columns = shared[at : at + COLUMNS]
        sides = []
        for values, owner, rows in ((all_a, own_a, len(a)), (all_b, own_b, len(b))):
            place = np.searchsorted(columns, values)
            place[place == len(columns)] = 0
            hit = columns[place] == values
            matrix = np.zeros((rows, len(columns)), np.float32)
            matrix[owner[hit], place[hit]] = 1
            sides.append(matrix)
        # Sums of at most COLUMNS ones are exact.
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def pair_bound(o: np.ndarray, n: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most shingles two sets of sizes n and m can share whose overlaps with a third are o and p."""
    return np.minimum(o, p) + np.minimum(n - o, m - p)


def derived_links(queries, members, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, id) links of sets that are not the leader's with members of its family.

    Both are (ids, sizes, overlaps with the leader, sets). Members are taken in
    the order of their sizes; blocks that the bound excludes are skipped.
    """
    order = np.argsort(members[1], kind="stable")
    ids, sizes, shares = (members[i][order] for i in range(3))
    sets = [members[3][i] for i in order]
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(ids), 128):
        part = slice(at, at + 128)
        bound = pair_bound(queries[2][:, None], queries[1][:, None], shares[part][None], sizes[part][None])
        possible = linked(bound, queries[1][:, None], sizes[part][None], percent) & (queries[0][:, None] != ids[part][None])
        rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
        if not len(rows):
            continue
        exact = overlaps([queries[3][i] for i in rows], [sets[at + j] for j in columns])
        hit = linked(exact, queries[1][rows][:, None], sizes[part][columns][None], percent) & possible[np.ix_(rows, columns)]
        i, j = np.nonzero(hit)
        found_a.append(queries[0][rows[i]])
        found_b.append(ids[part][columns[j]])
    return np.concatenate(found_a), np.concatenate(found_b)


def groups_of(batches: Batches, keys: list[str]) -> Iterator[dict[str, list]]:
    """Runs of rows with equal keys in a sorted stream, as lists of values."""
    held: dict[str, list] = {}
    for batch in batches:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        key_of = list(zip(*(columns[names.index(k)] for k in keys), strict=True))
        at = 0
        while at < batch.num_rows:
            end = at
            while end < batch.num_rows and key_of[end] == key_of[at]:
                end += 1
            if held and tuple(held[k][0] for k in keys) != key_of[at]:
                yield held
                held = {}
            for name, column in zip(names, columns, strict=True):
                held.setdefault(name, []).extend(column[at:end])
            at = end
    if held:
        yield held


def tasks(run):
    """``run`` as a function of batches that gives its memory back."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return whole


def as_sets(data: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(d, "<u8") for d in data]


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """For each document its set's size and fingerprint; for each task and slice of buckets its counts."""
    schema = "doc_id long, n long, k1 long, k2 long, slice int, counts binary"

    def run(batches: Batches) -> Batches:
        hashes, out = WordHashes(), arrow_type(schema)
        counts = np.zeros(len(ROW_FACTORS) << BUCKET_BITS - 1, np.uint8)
        any_shingles = False
        for batch in batches:
            rows, held, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                own = shingle_set(text, hashes, width)
                key = np.frombuffer(xxhash.xxh3_128_digest(own.astype("<u8").tobytes()), "<i8")
                rows.append((doc_id, len(own), int(key[0]), int(key[1])) if len(own) else (doc_id, 0, None, None))
                held.append(own)
                size += len(own)
                if size > 1 << 18:
                    _count(counts, held)
                    held, size, any_shingles = [], 0, True
            if size:
                _count(counts, held)
                any_shingles = True
            columns = list(zip(*rows, strict=True)) or [()] * 4
            empty = [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + empty, schema=out)
        for at in range((len(counts) >> SLICE_BITS - 1) if any_shingles else 0):
            part = counts[at << SLICE_BITS - 1 : at + 1 << SLICE_BITS - 1]
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([at], pa.int32()), pa.array([packed], pa.binary())], schema=out)

    return scan(docs, {"doc_id": "doc_id", "text": "text"}, run, schema)


def _count(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    """Add sets to the bucket counts, two to a byte, which stay at 15 once there."""
    buckets, times = np.unique(buckets_of(np.concatenate(sets)), return_counts=True)
    for half in (0, 1):
        own = buckets & 1 == half
        places, shift = buckets[own] >> 1, np.uint8(4 * half)
        held = counts[places]
        total = np.minimum(15, (held >> shift & 15) + np.minimum(times[own], 15)).astype(np.uint8)
        counts[places] = held & np.uint8(15 << 4 * (1 - half)) | total << shift


def _bucket_classes(slices: DataFrame) -> np.ndarray:
    """Four bits for every bucket of the whole corpus: a table of fixed size, whatever the corpus."""

    def run(batches: Batches) -> Batches:
        out = arrow_type("slice int, classes binary")
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total = totals.setdefault(at, np.zeros(1 << SLICE_BITS, np.uint32))
                pairs = np.frombuffer(zlib.decompress(packed), np.uint8)
                total[0::2] += pairs & 15
                total[1::2] += pairs >> 4
        for at, total in totals.items():
            packed = zlib.compress(packed_classes(order_class(total)).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], schema=out)

    summed = slices.select("slice", "counts").repartition("slice").mapInArrow(tasks(run), "slice int, classes binary")
    table = np.zeros(len(ROW_FACTORS) << BUCKET_BITS - 1, np.uint8)
    for row in summed.collect():
        table[row.slice << SLICE_BITS - 1 : row.slice + 1 << SLICE_BITS - 1] = np.frombuffer(zlib.decompress(row.classes), np.uint8)
    return table


def _entries(docs: DataFrame, table, width: int, percent: int) -> DataFrame:
    """The index: a row for every prefix shingle that another document may share."""

    def run(batches: Batches) -> Batches:
        hashes, out, classes = WordHashes(), arrow_type("shingle long, doc_id long"), table.value
        for batch in batches:
            shingles, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                own = shingle_set(text, hashes, width)
                if len(own):
                    shingles.append(prefix_of(own, classes_of(own, classes), percent))
                    owners.append(np.full(len(shingles[-1]), doc_id))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(owners))], schema=out)

    return scan(docs, {"doc_id": "doc_id", "text": "text"}, run, "shingle long, doc_id long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingle sets of some documents.

    A bounded table of marks thins the documents first, so that few other texts
    move; it lets some through, which the later join drops.
    """
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS))
    marks = wanted.select(mark("member").alias("mark")).distinct()
    few = docs.withColumn("mark", mark("doc_id")).join(F.broadcast(marks), "mark", "left_semi")

    def run(batches: Batches) -> Batches:
        hashes, out = WordHashes(), arrow_type("doc_id long, set binary")
        for batch in batches:
            sets = [shingle_set(t, hashes, width).astype("<u8").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], schema=out)

    return scan(few, {"doc_id": "doc_id", "text": "text"}, run, "doc_id long, set binary").dropDuplicates(["doc_id"])


def _compare_families(placed: DataFrame, percent: int) -> DataFrame:
    """Leaders with their members, block by block.

    Rows with ``other`` are links. Families of one block are finished here; of
    larger ones every member's overlap with the leader is returned as well.
    """
    schema = "leader long, block int, member long, other long, n long, overlap long"

    def run(batches: Batches) -> Batches:
        out = arrow_type(schema)
        for group in groups_of(batches, ["leader", "block"]):
            if group["role"][0] != 0 or len(group["role"]) < 2:
                continue
            leader, block = group["leader"][0], group["block"][0]
            sets = as_sets(group["set"])
            ids, own = np.array(group["member"][1:], np.int64), sets[1:]
            sizes = np.array([len(s) for s in own])
            shares = overlaps(sets[:1], own)[0]
            near = linked(shares, sizes, np.full(len(own), len(sets[0])), percent)
            child, root = ids[near], np.full(near.sum(), leader)
            if group["blocks"][0] == 1 and not near.all():
                rest = np.flatnonzero(~near)
                queries = (ids[rest], sizes[rest], shares[rest], [own[i] for i in rest])
                a, b = derived_links(queries, (ids, sizes, shares, own), percent)
                child, root = forest(np.concatenate([child, a]), np.concatenate([root, b]))
            rows = [(leader, block, int(c), int(r), None, None) for c, r in zip(child, root, strict=True)]
            if group["blocks"][0] > 1:
                rows += [(leader, block, int(i), None, int(n), int(o)) for i, n, o in zip(ids, sizes, shares, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    keys = ["leader", "block"]
    rows = placed.repartition(*keys).sortWithinPartitions(*keys, "role").select("leader", "block", "blocks", "role", "member", "set")
    return rows.mapInArrow(tasks(run), schema)


def _compare_blocks(tiles: DataFrame, percent: int) -> DataFrame:
    """Members that are not linked to their leader against a block of its family."""

    def run(batches: Batches) -> Batches:
        out = arrow_type("member long, other long")
        for group in groups_of(batches, ["leader", "query_block", "block"]):
            role = np.array(group["role"])
            ids, shares, sets = np.array(group["member"]), np.array(group["overlap"]), as_sets(group["set"])
            sizes = np.array([len(s) for s in sets])
            q, m = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(q) or not len(m):
                continue
            side = lambda k: (ids[k], sizes[k], shares[k], [sets[i] for i in k])  # noqa: B023, E731
            child, root = forest(*derived_links(side(q), side(m), percent))
            yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(root, pa.int64())], schema=out)

    keys = ["leader", "query_block", "block"]
    rows = tiles.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "role", "member", "overlap", "set")
    return rows.mapInArrow(tasks(run), "member long, other long")


def ngram_components(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Set size, class and component of every document.

    Words are lower-cased (A-Z) and split at ASCII white space. A set holds the
    distinct runs of ``width`` words, or the one run of all words of a shorter
    text. Two sets link when their Jaccard similarity is at least
    ``percent`` / 100. ``class_id`` is the smallest id of the documents with an
    equal set, ``component_id`` the smallest id reachable by links.

    One row per input row. Null, empty and word-free texts have an empty set and
    link with nothing, as do rows without an id, whose component is null. Rows of
    one id must have one text; repeated rows share class and component. Shingles
    are compared by 64-bit fingerprints and sets by 128 bits of theirs.

    The work beyond the scans grows with the entries of shared lists and, for
    families of several blocks, with the members not linked to their leader
    times the family.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    with_id = own.filter("doc_id is not null")
    summaries = parked(_summaries(own, width), "ngram-sets")
    sets = summaries.filter("slice is null").select("doc_id", "n", "k1", "k2")
    table = spark.sparkContext.broadcast(_bucket_classes(summaries.filter("slice is not null")))

    classes = sets.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"))
    members = parked(sets.join(classes, ["k1", "k2"], "left").select("doc_id", "n", "class_id"), "ngram-classes")

    entries = parked(_entries(with_id, table, width, percent), "ngram-index")
    lists = entries.groupBy("shingle").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last")
    in_lists = entries.join(lists.select("shingle", "leader"), "shingle").select("leader", "doc_id").distinct()
    # Equal sets stand in the same lists, so a leader is the smallest of its class.
    classed = members.filter("class_id is not null").select("doc_id", "class_id").distinct()
    families = in_lists.join(classed, "doc_id").select("leader", F.col("class_id").alias("member")).filter("leader <> member").distinct()
    families = parked(families, "ngram-families")
    table.unpersist()

    ids = families.select(F.explode(F.array("leader", "member")).alias("member")).distinct()
    heads = families.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    rows = families.join(heads, "leader").select("leader", block.alias("block"), "blocks", F.lit(1).alias("role"), "member")
    tops = heads.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.lit(0).alias("role"), F.col("leader").alias("member"))
    placed = rows.unionByName(tops).join(_sets(with_id, ids, width), F.col("member") == F.col("doc_id"))
    compared = parked(_compare_families(placed, percent), "ngram-links")
    links = compared.filter("other is not null").select("member", "other")

    large = compared.filter("other is null")
    if not large.isEmpty():
        linked_to_leader = links.select("member", F.col("other").alias("leader")).distinct()
        rest = large.join(linked_to_leader, ["leader", "member"], "left_anti").select("leader", "member", "overlap")
        rest_heads = rest.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("query_blocks"))
        rest = rest.join(heads, "leader").join(rest_heads, "leader")
        queries = rest.select(
            "leader", F.pmod(F.xxhash64("member"), F.col("query_blocks")).cast("int").alias("query_block"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "member", "overlap",
        )
        targets = large.join(rest_heads, "leader").select(
            "leader", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "block", F.lit(1).alias("role"), "member", "overlap",
        )
        tiles = queries.unionByName(targets)
        tiles = tiles.join(_sets(with_id, tiles.select("member"), width), F.col("member") == F.col("doc_id"))
        links = links.unionByName(_compare_blocks(tiles, percent))

    components = connected_components(links, "ngram")
    return members.join(components, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")
    )
