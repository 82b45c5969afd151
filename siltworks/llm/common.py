"""Shared helpers: Arrow scans, words, fingerprints, tokenizer files and intermediate tables."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.session import materialize

#: Entries a worker keeps in a cache of words before it starts afresh.
CACHE_ENTRIES = 200_000
#: Rows of a batch that functions see at once.
SLICE_ROWS = 1024

Batches = Iterator[pa.RecordBatch]


def made_once(key: tuple, make: Callable):
    """What a worker process makes once and keeps for its later tasks, such as a tokenizer.

    Functions travel to the workers by value and their globals last for one
    task, so the store hangs on a module of the process.
    """
    home = sys.modules.setdefault("siltworks_worker", types.ModuleType("siltworks_worker"))
    store = home.__dict__.setdefault("made", {})
    if key not in store:
        store[key] = make()
    return store[key]


def for_scan(scan_id: str) -> None:
    """Let go of the tools of other scans: workers outlive operators, and memory is short with two of them."""
    home = sys.modules.setdefault("siltworks_worker", types.ModuleType("siltworks_worker"))
    if home.__dict__.get("scan_id") != scan_id:
        home.__dict__.update(scan_id=scan_id, made={})


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def scan(df: DataFrame, columns: dict[str, str], function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """Run ``function`` over Arrow batches of some columns, renamed to fixed names.

    ``columns`` maps the fixed name to the column of ``df``. Other columns never
    reach Python, so their names cannot clash.
    """
    picked = df.select(*[df[source].alias(name) for name, source in columns.items()])
    scan_id = uuid.uuid4().hex

    def in_slices(batches: Batches) -> Batches:
        for_scan(scan_id)
        yield from function(batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))
        give_back()

    return picked.mapInArrow(in_slices, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}


def arrow_type(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of flat columns; needs no session, so tasks can use it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, schema.split(","))])


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Bytes methods know ASCII only, which is what is wanted."""
    return text.lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit values (a multiply-xorshift finaliser)."""
    x = values + np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


# Odd factors, one for each place in a shingle.
_PLACES = mixed(np.arange(1, 33, dtype=np.uint64), 5) | np.uint64(1)


def shingles_in_order(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """One 64-bit fingerprint for every run of ``k`` words; all words as one run if there are fewer; none without words."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * _PLACES[i]
    return mixed(total)


def by_size(texts: list[bytes], slice_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``slice_bytes`` together, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > slice_bytes:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def crc_of(doc_id: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode())


def json_tokenizer(path: str):
    """A ``tokenizers`` file without truncation and padding, single-threaded inside tasks."""

    def load():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return made_once(("tokenizer", path), load)


def parked(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there, on files that outlive executors."""
    return materialize(df, label)
