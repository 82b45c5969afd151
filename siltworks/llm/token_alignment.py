"""Alignment of two tokenizers' tokens by byte ranges, each distinct text once.

Documents are shuffled by their full text, so a text that many documents share
is tokenised and aligned once and weighs its number of copies in the counts of
linked id pairs. Two tokens are linked where their bytes overlap; both
tokenizations cut the same bytes, so between two neighbouring cuts of either
there is exactly one link. Pair counts come to rest in a table; its bounded head
of frequent pairs travels to the tasks, pairs beyond it meet their counts in a
join. Measures of the distinct texts are joined to the documents by a SHA-256.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import CACHE_ENTRIES, Batches, arrow_type, by_size, made_once, parked, scan, texts_of
from siltworks.llm.packing import byte_alphabet, fast_encoding, is_plain

#: Text bytes aligned at once.
SLICE_BYTES = 1 << 20
#: Characters of remembered segments and groups after which a worker starts afresh.
CACHE_CHARS = 32 << 20
#: Characters of segments encoded as one text.
BATCH_CHARS = 1 << 16
#: Pairs whose counts travel to the tasks; 17 bytes each.
HEAD_PAIRS = 1 << 20
#: A pair is one whole number: the id of A times this, and the id of B; vocabularies have up to 2^26 ids.
PAIR = 1 << 26
SCHEMA = "k string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


# What any version of Unicode or any library may take for white space.
_SPACE = r"[\s\u180e\u200b\ufeff]"
_SPACE_END = re.compile(_SPACE)
_UNEVEN = re.compile(_SPACE + " ")
_BREAK = re.compile(f"(?<!{_SPACE})(?= )")


class ByteLevel:
    """A byte-level ``tokenizers`` file; strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        self.fast = fast_encoding(made)
        before = made["pre_tokenizer"] or {}
        # Its pattern never joins a character with a space behind it.
        self.splits = not made["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.splits &= all(t["special"] for t in made["added_tokens"])
        alphabet = byte_alphabet()
        self.bytes_of = {}
        for token, i in self.tokenizer.get_vocab().items():
            # An added token need not be spelled in the alphabet; then it is its own bytes.
            plain = all(c in alphabet for c in token)
            self.bytes_of[i] = bytes(map(alphabet.__getitem__, token)) if plain else token.encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.encoded(" " + t) for t in texts]

    def encoded(self, text: str) -> list[int]:
        if self.fast is None or not is_plain(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A SentencePiece model; it puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as format_of

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        made = format_of.ModelProto()
        with open(path, "rb") as file:
            made.ParseFromString(file.read())
        normal = made.normalizer_spec
        # Merges run independently on both sides of a place that no piece reaches across.
        inner = any("▁" in p.piece.lstrip("▁") or p.type == p.USER_DEFINED for p in made.pieces)
        self.splits = made.trainer_spec.model_type == made.trainer_spec.BPE and normal.add_dummy_prefix
        self.splits &= not (inner or normal.precompiled_charsmap or normal.remove_extra_whitespaces or made.trainer_spec.treat_whitespace_as_suffix)
        self.space = self.model.piece_to_id("▁")
        self.bytes_of = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        # The library puts no space before nothing; here it stands for the last space of a text.
        return [ids if t else [self.space] for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]


def segments_of(text: str) -> list[str]:
    """A space and the text, cut before every space behind what is no white space, each part without its first space."""
    if _UNEVEN.search(" " + text):
        return [part[1:] for part in _BREAK.split(" " + text) if part]
    return text.split(" ")


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in A and B of all overlapping token pairs in order, and where a link ends on a cut of both.

    ``ends`` ascend and both end at the same byte; each byte range between
    neighbouring cuts belongs to one pair.
    """
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def spelled(groups_a: np.ndarray, groups_b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3;`` as names and marks in turn, by the group (from 0, ascending) of each."""
    out = np.empty(2 * (len(names_a) + len(names_b)), object)
    # A's tokens of a group stand before B's.
    at_a = np.arange(len(names_a)) + np.searchsorted(groups_b, groups_a, "left")
    at_b = np.arange(len(names_b)) + np.searchsorted(groups_a, groups_b, "right")
    out[1::2] = ","
    out[2 * at_a], out[2 * at_b] = names_a, names_b
    out[2 * at_a[np.flatnonzero(np.diff(groups_a, append=len(out)))] + 1] = "|"
    out[2 * at_b[np.flatnonzero(np.diff(groups_b, append=len(out)))] + 1] = ";"
    return out.tolist()


def by_chars(segments: list[str], most: int):
    """Deal segments into batches of about ``most`` characters."""
    batch, size = [], 0
    for segment in segments:
        batch.append(segment)
        size += len(segment)
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Aligner:
    """What both tokenizers make of segments of texts, remembered up to a bound.

    Both cut a text at the same places between its segments, so a text's tokens,
    groups and links are those of its segments one behind the other. With a
    tokenizer that may reach across such places a text is one segment.
    """

    def __init__(self, path_a: str, path_b: str):
        self.tools = ByteLevel(path_a), Pieces(path_b)
        self.splits = all(tool.splits for tool in self.tools)
        self.sizes, self.names = [], []
        for tool in self.tools:
            size = np.zeros(max(tool.bytes_of) + 1, np.int64)
            for i, b in tool.bytes_of.items():
                size[i] = len(b)
            self.sizes.append(size)
            self.names.append(np.array([str(i) for i in range(len(size))], object))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        #: Tokens of A, tokens of B, groups, links, and 1 where a tokenizer changes the bytes, by segment.
        self.measures = [np.empty((0, 5), np.int64)]
        self.first, self.links = [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
        self.kept = 0

    def learn(self, segments: set[str]) -> None:
        if len(self.number) > CACHE_ENTRIES or self.kept > CACHE_CHARS:
            self.forget()
        fresh = [s for s in segments if s not in self.number]
        # Behind white space or nothing, another segment would not be cut off.
        joined = self.splits and [s for s in fresh if s and not _SPACE_END.match(s[-1]) and "▁" not in s]
        for batch in by_chars(joined or [], BATCH_CHARS):
            self._learn(batch)
        for segment in fresh:
            if segment not in self.number:
                self._learn([segment])

    def _learn(self, segments: list[str]) -> None:
        """Take in segments that are encoded as one text, or one by one where its cuts are not those of the segments."""
        text = " ".join(segments)
        whole = b" " + text.encode()
        both = [np.array(tool([text])[0], np.int64) for tool in self.tools]
        if any(b"".join(map(tool.bytes_of.__getitem__, ids.tolist())) != whole for tool, ids in zip(self.tools, both, strict=True)):
            if len(segments) > 1:
                for segment in segments:
                    self._learn([segment])
                return
            self._keep(segments, [""], np.array([[0, 0, 0, 0, 1]]), np.empty(0, np.int64))
            return
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self.sizes, both, strict=True))
        cuts = np.cumsum([len(s.encode()) + 1 for s in segments])
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        if len(segments) > 1 and not ((ends_a[last_a] == cuts).all() and (ends_b[last_b] == cuts).all()):
            for segment in segments:
                self._learn([segment])
            return
        a, b, closed = links_of(ends_a, ends_b)
        common = ends_a[a[closed]]
        names = spelled(*(np.searchsorted(common, e) for e in (ends_a, ends_b)), *(n[ids] for n, ids in zip(self.names, both, strict=True)))
        links_upto = np.searchsorted(np.minimum(ends_a[a], ends_b[b]), cuts, "right")
        upto = np.stack([last_a + 1, last_b + 1, np.searchsorted(common, cuts) + 1, links_upto], axis=1)
        measures = np.zeros((len(segments), 5), np.int64)
        measures[:, :4] = np.diff(upto, axis=0, prepend=0)
        tokens = [0, *(2 * (upto[:, 0] + upto[:, 1])).tolist()]
        groups = ["".join(names[i : j - 1]) for i, j in zip(tokens, tokens[1:], strict=False)]
        self._keep(segments, groups, measures, both[0][a] * PAIR + both[1][b])

    def _keep(self, segments: list[str], groups: list[str], measures: np.ndarray, links: np.ndarray) -> None:
        self.number.update(zip(segments, range(len(self.number), len(self.number) + len(segments)), strict=True))
        self.groups += groups
        self.kept += sum(map(len, groups)) + sum(map(len, segments))
        self.measures.append(measures)
        self.first.append(self.first[-1][-1] + np.cumsum(measures[:, 3]))
        self.links.append(links)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Measures and groups of each text, then (text, pair, times) of the linked pairs, texts in order.

        A text that is empty or whose bytes a tokenizer changes has zeros, no groups and no pairs.
        """
        segments = [segments_of(t) if self.splits else [t] for t in texts]
        self.learn({s for own in segments for s in own})
        self.measures, self.first, self.links = [np.concatenate(self.measures)], [np.concatenate(self.first)], [np.concatenate(self.links)]
        known, first, links = self.measures[0], self.first[0], self.links[0]
        lengths = np.array([len(own) for own in segments], np.int64)
        numbers = [list(map(self.number.__getitem__, own)) for own in segments]
        number = np.fromiter(chain.from_iterable(numbers), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        measures = np.zeros((len(texts), 5), np.int64)
        np.add.at(measures, owner, known[number])
        void = (measures[:, 4] > 0) | np.array([not t for t in texts], bool)
        measures[void] = 0
        name = self.groups.__getitem__
        groups = ["" if v else ";".join(map(name, own)) for v, own in zip(void.tolist(), numbers, strict=True)]
        # Distinct segments of each text first, then their links.
        key, times = np.unique((owner * len(self.number) + number)[~void[owner]], return_counts=True)
        owner, number = np.divmod(key, max(len(self.number), 1))
        size = first[number + 1] - first[number]
        places = np.arange(size.sum()) + np.repeat(first[number] - (np.cumsum(size) - size), size)
        pair, place = np.unique(links[places], return_inverse=True)
        key, place = np.unique(np.repeat(owner, size) * max(len(pair), 1) + place, return_inverse=True)
        total = np.bincount(place, np.repeat(times, size), len(key)).astype(np.int64)
        owner, place = np.divmod(key, max(len(pair), 1))
        return measures, groups, owner, pair[place], total


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Measures of texts (k, text, copies), with their linked pairs and how often each text holds them."""
    schema = f"{SCHEMA}, copies long, pairs array<long>, times array<long>"

    def run(batches: Batches) -> Batches:
        tool = made_once(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        lists = pa.list_(pa.int64())
        out = pa.schema([*arrow_type(f"{SCHEMA}, copies long"), ("pairs", lists), ("times", lists)])
        for batch in batches:
            whole = texts_of(batch)
            for first, last in by_size(whole, SLICE_BYTES):
                measures, groups, owner, pairs, times = tool.texts([t.decode() for t in whole[first:last]])
                offsets = pa.array(np.searchsorted(owner, np.arange(last - first + 1)), pa.int32())
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k").slice(first, last - first),
                        *(pa.array(measures[:, i]) for i in range(4)),
                        pa.array(hashes, pa.string()),
                        batch.column("copies").slice(first, last - first),
                        pa.ListArray.from_arrays(offsets, pa.array(pairs)),
                        pa.ListArray.from_arrays(offsets, pa.array(times)),
                    ],
                    schema=out,
                )

    return scan(texts, {c: c for c in ("k", "text", "copies")}, run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): corpus-wide links of every id pair, and whether no pair of its B id has more.

    Tasks add up what they hold before anything is shuffled; the window of an id
    of B holds one row for each id of A at the most.
    """
    links = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("e"))
    counts = links.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum(F.col("e.times") * F.col("copies")).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % PAIR))
    return counts.withColumn("best", F.col("n") == most)


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The pairs of the largest counts, ``most`` at the most: all whose count has a number of bits that a histogram finds."""
    level = F.floor(8 * F.log2(F.col("n"))).cast("int")
    total, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def align_tokenizers(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """How the tokens of a byte-level file (A) and of a SentencePiece model (B) lie on each text.

    Returns doc_id, n_a and n_b (tokens), n_groups (byte ranges between cuts of
    both), n_links (overlapping pairs of tokens), n_best (links whose count in
    the corpus no pair of the same B id exceeds), count_sum (of the counts over
    the links) and the SHA-256 of the groups. A reads a space and the text. One
    row per input row; every row of a repeated text counts. Null and empty
    texts, and those whose bytes either tokenizer changes (B folds characters and
    runs of spaces), have no tokens: zeros and an empty hash.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    texts = own.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = parked(aligned_texts(texts.select(F.sha2("text", 256).alias("k"), "text", "copies"), path_a, path_b), "aligned-texts")
    counts = parked(pair_counts(aligned), "pair-counts")
    head = _head(counts, head_pairs).toArrow()
    order = np.argsort(head["pair"].to_numpy())
    table = docs.sparkSession.sparkContext.broadcast(tuple(head[c].to_numpy()[order] for c in ("pair", "n", "best")))
    schema = "k string, n_best long, count_sum long, pairs array<long>, times array<long>"

    def look_up(batches: Batches) -> Batches:
        lists = pa.list_(pa.int64())
        out = pa.schema([*arrow_type("k string, n_best long, count_sum long"), ("pairs", lists), ("times", lists)])
        known, n, best = table.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").values.to_numpy()
            offsets, flat = pairs.offsets.to_numpy(), pairs.values.to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            flat, times = flat[offsets[0] : offsets[-1]], times[offsets[0] : offsets[-1]]
            place = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            found = known[place] == flat if len(known) else np.zeros(len(flat), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            at = place[found]
            np.add.at(sums[0], rows[found], times[found] * best[at])
            np.add.at(sums[1], rows[found], times[found] * n[at])
            rest = pa.array(np.searchsorted(rows[~found], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(rest, pa.array(flat[~found])), pa.ListArray.from_arrays(rest, pa.array(times[~found]))], schema=out
            )

    looked_up = parked(scan(aligned, {c: c for c in ("k", "pairs", "times")}, look_up, schema), "frequent-pairs")
    rare = looked_up.filter(F.size("pairs") > 0).select("k", F.explode(F.arrays_zip("pairs", "times")).alias("e"))
    rare = rare.select("k", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times")).join(counts, "pair")
    rare = rare.groupBy(F.col("k").alias("rare_k")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum")
    )
    sums = looked_up.select("k", "n_best", "count_sum").join(rare, F.col("k") == F.col("rare_k"), "left").select(
        F.col("k").alias("sums_k"),
        (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
    )
    measures = aligned.drop("copies", "pairs", "times").join(sums, F.col("k") == F.col("sums_k"))
    keyed = own.select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    columns = [zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return keyed.join(measures, F.col("own") == F.col("k"), "left").select("doc_id", *columns, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
