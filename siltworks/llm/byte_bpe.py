"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Tasks split the
chunks into pre-tokens in parallel. The pattern never looks back, so once two
neighbouring chunks begin a pre-token at the same place they agree from there
on: that place stitches them. The stitched pre-tokens are encoded by the ranks,
each on its own; decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import CACHE_ENTRIES, Batches, arrow_type, made_once, scan, texts_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Starts at the end of a chunk that a longer text might have moved: the last
#: pre-token may go on, and one before it may be the head of a contraction.
UNSURE_STARTS = 2


class RankCodec:
    """Pre-tokens to ids by the ranks of a tiktoken file, and back."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[str, list[int]] = {}

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def starts(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), np.int64)

    def encode(self, pretokens: Iterable[str]) -> np.ndarray:
        # By the ranks alone: the library's pattern gives up on a million spaces.
        known, encode = self.known, self.encoding._encode_single_piece
        if len(known) > CACHE_ENTRIES:
            known.clear()
        ids: list[int] = []
        for piece in pretokens:
            own = known.get(piece)
            if own is None:
                own = encode(piece.encode())
                if len(piece) <= 64:
                    known[piece] = own
            ids += own
        return np.array(ids, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def codec(ranks_path: str, pattern: str) -> RankCodec:
    return made_once(("codec", ranks_path, pattern), lambda: RankCodec(ranks_path, pattern))


def stitched(text: str, offsets: list[int], starts: list[np.ndarray], tool: RankCodec) -> list[str]:
    """The pre-tokens of ``text`` from those of its overlapping chunks.

    ``starts[i]`` are the places in ``text`` where chunk ``i``, which begins at
    ``offsets[i]``, starts its pre-tokens, without the unsure ones at its end. A
    chunk pair without a common place (a pre-token longer than the overlap) is
    bridged by splitting the text from the last certain place on.
    """
    sure = starts[0]
    for own in starts[1:]:
        common = np.intersect1d(sure[np.searchsorted(sure, own[0] if len(own) else 0) :], own, assume_unique=True)
        if not len(common):
            last = int(sure[-1]) if len(sure) else 0
            sure = np.concatenate([sure[:-1], last + tool.starts(text[last:])])
            return _cut(text, sure)
        sure = np.concatenate([sure[: np.searchsorted(sure, common[0])], own[np.searchsorted(own, common[0]) :]])
    last = int(sure[-1]) if len(sure) else 0
    return _cut(text, np.concatenate([sure[:-1], last + tool.starts(text[last:])]))


def _cut(text: str, starts: np.ndarray) -> list[str]:
    ends = [*starts[1:].tolist(), len(text)]
    return [text[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]


def digest(tool: RankCodec, pretokens: list[str]) -> tuple[int, str, str]:
    ids = tool.encode(pretokens)
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()


def byte_bpe(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 24_000,
    overlap_chars: int = 256,
) -> DataFrame:
    """Ids of every text and the bytes they decode to, each as a SHA-256, with the number of ids.

    One row per input row, repeated rows and repeated ids included. Null and
    empty texts have no ids; their digests are those of no bytes. Only texts
    longer than a chunk are shuffled, chunk by chunk, so that one long text
    occupies many tasks; the chunks of one row meet again to be stitched. No run
    of one character is too long.
    """

    def whole(batches: Batches) -> Batches:
        tool, out = codec(ranks_path, pattern), arrow_type(SCHEMA)
        for batch in batches:
            rows = [digest(tool, tool.pretokens(t.decode())) for t in texts_of(batch)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64())]
                + [pa.array(c, t.type) for c, t in zip(columns, list(out)[1:], strict=True)],
                schema=out,
            )

    def split(frames):
        tool = codec(ranks_path, pattern)
        for frame in frames:
            starts = []
            for text, offset, last in zip(frame.piece, frame.chunk * chunk_chars, frame["last"], strict=True):
                own = tool.starts(text) + offset
                starts.append((own if last else own[: max(1, len(own) - UNSURE_STARTS)]).astype("<i8").tobytes())
            yield frame[["row", "doc_id", "chunk", "piece"]].assign(starts=starts)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        tool = codec(ranks_path, pattern)
        frame = frame.sort_values("chunk")
        offsets = (frame.chunk * chunk_chars).tolist()
        text = "".join(p[:chunk_chars] for p in frame.piece)
        starts = [np.frombuffer(s, "<i8") for s in frame.starts]
        n, ids, decoded = digest(tool, stitched(text, offsets, starts, tool))
        return pd.DataFrame({"doc_id": frame.doc_id.iloc[:1], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = scan(own.filter(~is_long), {"doc_id": "doc_id", "text": "text"}, whole, SCHEMA)
    n_chunks = F.ceil(F.length("text") / chunk_chars).cast("int")
    chunks = (
        own.filter(is_long)
        .select("doc_id", F.monotonically_increasing_id().alias("row"), "text", n_chunks.alias("n"))
        .select("row", "doc_id", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
        .select(
            "row",
            "doc_id",
            F.col("chunk").cast("long").alias("chunk"),
            (F.col("chunk") == F.col("n") - 1).alias("last"),
            F.substring("text", F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars + overlap_chars)).alias("piece"),
        )
        .repartition("row", "chunk")
        .mapInPandas(split, "row long, doc_id long, chunk long, piece string, starts binary")
    )
    return short.unionByName(chunks.groupBy("row").applyInPandas(join, SCHEMA))
