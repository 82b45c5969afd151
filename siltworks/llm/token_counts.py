"""Token counts: batches of about equal bytes are encoded in Arrow functions that return lengths only.

The tokenizer drops white space and no token, normal form or special string
reaches across ASCII white space, so every such place is a safe boundary. Texts
are split there, however long they are; each distinct piece is encoded once and
its length is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltworks.llm.common import CACHE_ENTRIES, Batches, arrow_type, json_tokenizer, made_once, scan, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A piece longer than this is encoded but not remembered.
REMEMBERED_BYTES = 64


def by_bytes(pieces: list[bytes], batch_bytes: int) -> Iterator[list[bytes]]:
    """Deal pieces into batches of about ``batch_bytes``; a longer piece is a batch of its own."""
    batch, size = [], 0
    for piece in pieces:
        if batch and size + len(piece) > batch_bytes:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += len(piece)
    if batch:
        yield batch


def lengths_of(pieces: list[bytes], tokenizer) -> list[int]:
    """Tokens of each piece. The pieces are encoded as one text; the offsets of its tokens tell them apart."""
    plain = [p.decode() for p in pieces]
    offsets = tokenizer.encode(" ".join(plain), add_special_tokens=False).offsets
    starts = np.fromiter((a for a, _ in offsets), np.int64, len(offsets))
    ends = np.cumsum([len(p) + 1 for p in plain])
    return np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(pieces)).tolist()


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 64 * 1024,
) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    One row per input row, repeated rows included. A null or empty text has no
    bytes and no tokens. Special strings inside a text count as the tokenizer
    file's default has it. Columns other than the two named are ignored. No
    shuffle: each scan task keeps its own lengths of pieces.
    """

    def count(batches: Batches) -> Batches:
        tokenizer = json_tokenizer(tokenizer_path)
        lengths: dict[bytes, int] = made_once(("lengths", tokenizer_path), dict)
        out = arrow_type(SCHEMA)
        for batch in batches:
            texts = texts_of(batch)
            pieces = [t.split() for t in texts]
            if len(lengths) > CACHE_ENTRIES:
                lengths.clear()
            fresh = {p for own in pieces for p in own}
            fresh.difference_update(lengths)
            passing: dict[bytes, int] = {}
            for part in by_bytes(list(fresh), batch_bytes):
                for piece, n in zip(part, lengths_of(part, tokenizer), strict=True):
                    (lengths if len(piece) <= REMEMBERED_BYTES else passing)[piece] = n
            if passing:
                lookup = lambda p: lengths[p] if p in lengths else passing[p]  # noqa: B023, E731
            else:
                lookup = lengths.__getitem__
            tokens = [sum(map(lookup, own)) for own in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                schema=out,
            )

    return scan(docs, {"doc_id": id_col, "text": text_col}, count, SCHEMA)
