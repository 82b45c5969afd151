"""Hierarchical packing of documents into sequences of several context sizes.

Documents are routed to tiers by length. Whole windows of the longest context
are cut off long documents; what remains goes to the smallest tier that holds
it. Each tier, from the longest down, opens windows of its own size with its own
documents and fills the gaps with the longest fitting documents of shorter
tiers; a gap that none fits is closed by cutting one, so a window is left unfull
only when a batch has no tokens any more. That last window is cut at powers of
two. Sequences of a tier are then dealt to step groups of about equal work.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siltworks.llm.common import Batches, arrow_type, json_tokenizer, made_once, scan, texts_of

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context int, step_group long"
)
#: Tokens packed together by a task; bounds its memory.
BATCH_TOKENS = 3_000_000
#: Bits of a sequence id that number the sequences of one task.
TASK_BITS = 36

#: Texts as long as this go to ``tokenizers``; its white-space pattern has no limit to its depth.
LONG_CHARS = 500_000
# Letters on which the libraries' versions of Unicode cannot differ.
_BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_encoding(made: dict):
    """tiktoken's encoder for a byte-level ``tokenizers`` file, given as parsed JSON; None if its merges are not its vocabulary in order."""
    import public_tokenizers
    import tiktoken

    alphabet = byte_alphabet()
    added = {t["content"]: t["id"] for t in made["added_tokens"]}
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"])
    before = made["pre_tokenizer"] or {}
    if made["normalizer"] or not plain or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        return None
    vocabulary = made["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
    merged = [vocabulary.get(a + b, -1) for a, b in merges]
    single = max((i for t, i in vocabulary.items() if len(t) == 1), default=-1)
    own = {t for t in vocabulary if len(t) > 1 and t not in added}
    if any(b <= a for a, b in zip([single, *merged], merged, strict=False)) or own != {a + b for a, b in merges}:
        return None
    ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocabulary.items() if t not in added}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def is_plain(text: str) -> bool:
    """Whether tiktoken and ``tokenizers`` cannot differ: no letters beyond the Latin blocks, nor as long as tiktoken's pattern may fail on (a million spaces)."""
    return len(text) < LONG_CHARS and not _BEYOND_LATIN.search(text)


class IdsOfTexts:
    """Texts to ids by a byte-level ``tokenizers`` file.

    Where the merges of the file are its vocabulary in order, tiktoken's loop,
    which is several times faster, gives the same ids. Texts with letters beyond
    the Latin blocks, where the libraries' versions of Unicode could differ, very
    long texts and files of another make are encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        self.tokenizer = json_tokenizer(path)
        self.fast = fast_encoding(json.loads(self.tokenizer.to_str()))

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or not is_plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode(text, allowed_special="all"), "<u4")


class Pool:
    """Pieces (length, order, document, start) that wait to be packed, by length."""

    def __init__(self, pieces: list[tuple[int, int, int, int]]):
        self.pieces = sorted(pieces)

    def add(self, piece: tuple[int, int, int, int]) -> None:
        self.pieces.insert(bisect_right(self.pieces, piece), piece)

    def longest(self, above: int, most: int) -> tuple[int, int, int, int] | None:
        """Take the longest piece of more than ``above`` and at most ``most`` tokens."""
        at = bisect_left(self.pieces, (most + 1,)) - 1
        return self.pieces.pop(at) if at >= 0 and self.pieces[at][0] > above else None

    def shortest_over(self, least: int) -> tuple[int, int, int, int] | None:
        at = bisect_left(self.pieces, (least + 1,))
        return self.pieces.pop(at) if at < len(self.pieces) else None


def pack(lengths: list[int], contexts: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (context, [(document, start, length), ...]); every token in exactly one.

    ``contexts`` are powers of two, the longest first.
    """
    longest = contexts[0]
    sequences: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting = []
    for doc, length in enumerate(lengths):
        full = length // longest
        sequences += [(longest, [(doc, i * longest, longest)]) for i in range(full)]
        if length % longest:
            waiting.append((length % longest, doc, doc, full * longest))
    pool = Pool(waiting)
    for context, below in zip(contexts, [*contexts[1:], 0], strict=True):
        while first := pool.longest(below, context):
            window, gap = [first], context - first[0]
            while gap:
                if piece := pool.longest(0, gap):
                    window.append(piece)
                    gap -= piece[0]
                elif piece := pool.shortest_over(gap):
                    length, order, doc, start = piece
                    window.append((gap, order, doc, start))
                    pool.add((length - gap, order, doc, start + gap))
                    gap = 0
                else:
                    break
            placed = [(doc, start, length) for length, _, doc, start in window]
            sequences += [(context, placed)] if not gap else powers_of_two(placed)
    return sequences


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Cut a window that nothing fills any more into sequences whose sizes are powers of two."""
    out, pieces = [], list(pieces)
    total = sum(p[2] for p in pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        own, room = [], size
        while room:
            doc, start, length = pieces.pop(0)
            own.append((doc, start, min(room, length)))
            if length > room:
                pieces.insert(0, (doc, start + room, length - room))
            room -= own[-1][2]
        out.append((size, own))
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], group_size: int) -> list[int]:
    """A group for each sequence: of one context, about ``group_size`` sequences, and about equal attention work."""
    groups, first = [0] * len(sequences), 0
    for context in sorted({c for c, _ in sequences}, reverse=True):
        own = [i for i, (c, _) in enumerate(sequences) if c == context]
        own.sort(key=lambda i: (-sum(n * n for _, _, n in sequences[i][1]), i))
        n_groups = -(-len(own) // group_size)
        for rank, i in enumerate(own):
            turn, place = divmod(rank, n_groups)
            groups[i] = first + (place if turn % 2 == 0 else n_groups - 1 - place)
        first += n_groups
    return groups


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    contexts: tuple[int, ...] = (1024, 512, 256, 128),
    end_id: int = 0,
    group_size: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents placed in sequences of the given context sizes.

    Every text, null counting as empty, becomes its ids and ``end_id``; each id
    lies in one piece. Repeated rows are packed as often as they come. Tasks pack
    what they have scanned, in batches of bounded tokens, without a shuffle; ids
    of sequences and groups begin with the number of the task. No run of one
    character is too long.
    """
    sizes = sorted(contexts, reverse=True)
    if not sizes or any(c < 1 or c & (c - 1) for c in sizes):
        raise ValueError("context sizes must be powers of two")

    def run(batches: Batches) -> Batches:
        ids_of, out = made_once(("ids", tokenizer_path), lambda: IdsOfTexts(tokenizer_path)), arrow_type(SCHEMA)
        task = TaskContext.get().partitionId() << TASK_BITS
        seen = {"sequence": 0, "group": 0}

        def packed(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            sequences = pack([len(i) for i in ids], sizes)
            groups = step_groups(sequences, group_size)
            rows = []
            for number, ((context, pieces), group) in enumerate(zip(sequences, groups, strict=True)):
                offset = 0
                for doc, start, length in pieces:
                    crc = zlib.crc32(ids[doc][start : start + length])
                    rows.append((doc_ids[doc], start, length, crc, len(ids[doc]), task + seen["sequence"] + number, offset, context, task + seen["group"] + group))
                    offset += length
            seen["sequence"] += len(sequences)
            seen["group"] += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        doc_ids, ids, tokens = [], [], 0
        for batch in batches:
            texts, own = texts_of(batch), batch.column("doc_id").to_pylist()
            for doc_id, text in zip(own, texts, strict=True):
                doc_ids.append(doc_id)
                ids.append(np.append(ids_of(text.decode()), np.uint32(end_id)))
                tokens += len(ids[-1])
                if tokens >= BATCH_TOKENS:
                    yield packed(doc_ids, ids)
                    doc_ids, ids, tokens = [], [], 0
        if ids:
            yield packed(doc_ids, ids)

    return scan(docs, {"doc_id": id_col, "text": text_col}, run, SCHEMA)
