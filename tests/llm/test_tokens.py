"""Token counts, byte BPE and packing against the libraries themselves."""

import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import EDGE_TEXTS, by_id
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltworks.llm.byte_bpe import UNSURE_STARTS, RankCodec, byte_bpe, stitched
from siltworks.llm.packing import IdsOfTexts, fast_encoding, pack, pack_documents, step_groups
from siltworks.llm.token_counts import by_bytes, token_counts

@pytest.fixture(scope="module")
def ids_of():
    found = IdsOfTexts(P.path("byte_bpe_50k.json"))
    assert found.fast is not None
    return found


ODD = st.text(st.sampled_from("ab 'stre\n\t 　é1²!<|>endoftx"), max_size=60)


@pytest.fixture(scope="module")
def codec():
    return RankCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def bytes_json():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(edge_docs, documents):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for docs, texts in ((edge_docs, EDGE_TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        found = by_id(token_counts(docs, P.path("word_bpe_49k.json"), limit=100))
        for doc_id, text in texts:
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert found[doc_id] == {"doc_id": doc_id, "n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 100}


def test_counts_of_no_rows(no_docs):
    assert token_counts(no_docs, P.path("word_bpe_49k.json")).count() == 0


def test_batches_by_bytes():
    assert list(by_bytes([b"aa", b"b", b"cccccc", b"d"], 3)) == [[b"aa", b"b"], [b"cccccc"], [b"d"]]


@pytest.mark.parametrize("chunk", [50, 24_000])
def test_byte_bpe_equals_the_library(edge_docs, documents, codec, bytes_json, chunk):
    small = documents.filter("doc_id < 60")
    for docs, texts in ((edge_docs, EDGE_TEXTS), (small, [(r.doc_id, r.text) for r in small.collect()])):
        if chunk == 50:
            docs, texts = docs.filter("length(text) < 5000 or text is null"), [t for t in texts if len(t[1] or "") < 5000]
        found = by_id(byte_bpe(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_chars=chunk, overlap_chars=12))
        assert len(found) == len(dict(texts))
        for doc_id, text in texts:
            ids = np.array(codec.encoding.encode_ordinary(text or "") if doc_id != 20 else bytes_json.encode(text).ids, "<u4")
            row = found[doc_id]
            assert row["n_tokens"] == len(ids)
            assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
            assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_of_no_rows(no_docs):
    assert byte_bpe(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@settings(max_examples=400, deadline=None)
@given(ODD.filter(bool), st.integers(1, 9), st.integers(1, 9))
def test_stitching_gives_the_pretokens_of_the_whole(codec, text, chunk, overlap):
    offsets = list(range(0, len(text), chunk))
    starts = []
    for offset in offsets:
        own = codec.starts(text[offset : offset + chunk + overlap]) + offset
        starts.append(own if offset == offsets[-1] else own[: max(1, len(own) - UNSURE_STARTS)])
    assert stitched(text, offsets, starts, codec) == codec.pretokens(text)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_ids_equal_the_library(bytes_json, ids_of, text):
    assert ids_of(text).tolist() == bytes_json.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packing_fills_every_sequence(lengths):
    sequences = pack(lengths, [64, 32, 16])
    covered = defaultdict(list)
    for context, pieces in sequences:
        assert sum(n for _, _, n in pieces) == context and context & (context - 1) == 0 and context <= 64
        for doc, start, n in pieces:
            assert n > 0
            covered[doc].append((start, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(covered[doc]):
            assert start == at
            at += n
        assert at == length
    groups = step_groups(sequences, 4)
    members = defaultdict(list)
    for g, (context, _) in zip(groups, sequences, strict=True):
        members[g].append(context)
    assert all(len(set(m)) == 1 and len(m) <= 4 for m in members.values())


def test_packed_documents(edge_docs, documents, bytes_json):
    for docs, texts in ((edge_docs, EDGE_TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        rows = pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append(r)
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024 and at & (at - 1) == 0
        times = defaultdict(int)
        for doc_id, _ in texts:
            times[doc_id] += 1
        for doc_id, text in dict(texts).items():
            ids = np.array([*bytes_json.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            assert sum(r.length for r in pieces[doc_id]) == len(ids) * times[doc_id]
            for r in pieces[doc_id]:
                assert r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_packing_of_no_rows_and_bad_contexts(no_docs):
    assert pack_documents(no_docs, P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        pack_documents(no_docs, P.path("byte_bpe_50k.json"), contexts=(1000,))


def test_the_rank_file_is_the_vocabulary_of_the_json(codec, bytes_json):
    text = "The 3 quick brown foxes' dens — naïve?\n\n  Done."
    assert isinstance(codec.encoding, tiktoken.Encoding)
    assert codec.encode(codec.pretokens(text)).tolist() == bytes_json.encode(text).ids


RUNS = {
    "spaces": " " * 1_000_000,
    "line feeds": "\n" * 1_000_000,
    "mixed": " \n\t" * 333_334 + "end",
    "no-break spaces": "\xa0" * 1_000_000,
    "one letter": "a" * 1_000_000,
    "one digit": "x" + "1" * 1_000_000,
    "over the ends of chunks": "ab" * 12_000 + " " * 1_000_000 + "x",
}


def test_runs_of_a_million_characters(spark, bytes_json):
    docs = spark.createDataFrame(list(enumerate(RUNS.values())), "doc_id long, text string").repartition(4)
    encoded = by_id(byte_bpe(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    packed = defaultdict(list)
    for r in pack_documents(docs, P.path("byte_bpe_50k.json")).collect():
        packed[r.doc_id].append(r)
    for i, text in enumerate(RUNS.values()):
        ids = np.array(bytes_json.encode(text, add_special_tokens=False).ids, "<u4")
        assert encoded[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert encoded[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        ids = np.append(ids, np.uint32(0)).astype("<u4")
        assert sum(r.length for r in packed[i]) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in packed[i])


def test_merges_in_another_order_are_left_to_the_library(bytes_json):
    made = json.loads(bytes_json.to_str())
    assert fast_encoding(made) is not None
    made["model"]["merges"][:2] = made["model"]["merges"][1::-1]
    assert fast_encoding(made) is None
