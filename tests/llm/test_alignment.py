"""Cross-tokenizer alignment against a plain version of whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from cases import EDGE_TEXTS, by_id
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm.token_alignment import PAIR, Aligner, align_tokenizers, links_of, segments_of

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = "ab 'stre\n\t 　é1²!<|>endoftx▁\x1c​᠎  🎉ß\x00\xa0"


@pytest.fixture(scope="module")
def aligner():
    found = Aligner(*FILES)
    assert found.splits
    return found


def plain(tool, text):
    """(tokens of A, of B, groups, links by pair) of a whole text by comparing byte ranges; None if it has no tokens."""
    if not text:
        return None
    whole, spans = b" " + text.encode(), []
    both = (tool.tools[0].tokenizer.encode(" " + text, add_special_tokens=False).ids, tool.tools[1].model.encode(text))
    for ids, own in zip(both, tool.tools, strict=True):
        if b"".join(own.bytes_of[i] for i in ids) != whole:
            return None
        ends = np.cumsum([len(own.bytes_of[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids, strict=False)))
    links, low = Counter(), 0
    for start, end, a in spans[0]:
        while spans[1][low][1] <= start:
            low += 1
        k = low
        while k < len(spans[1]) and spans[1][k][0] < end:
            links[a, spans[1][k][2]] += 1
            k += 1
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    names = [{c: [] for c in cuts} for _ in spans]
    for own, out in zip(spans, names, strict=True):
        c = iter(cuts)
        cut = next(c)
        for _, end, i in own:
            while end > cut:
                cut = next(c)
            out[cut].append(str(i))
    groups = ";".join(",".join(names[0][c]) + "|" + ",".join(names[1][c]) for c in cuts)
    return len(both[0]), len(both[1]), len(cuts), groups, links


def brute_force(tool, texts):
    own = [plain(tool, t) for _, t in texts]
    total = Counter()
    for row in own:
        total.update(row[4] if row else {})
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    out = {}
    for (i, _), row in zip(texts, own, strict=True):
        a, b, groups, text, links = row or (0, 0, 0, None, {})
        out[i] = {
            "doc_id": i, "n_a": a, "n_b": b, "n_groups": groups, "n_links": sum(links.values()),
            "n_best": sum(n for pair, n in links.items() if total[pair] == most[pair[1]]),
            "count_sum": sum(n * total[pair] for pair, n in links.items()),
            "groups_sha256": hashlib.sha256(text.encode()).hexdigest() if text else "",
        }
    return out


def test_links_by_hand():
    a, b, closed = links_of(np.array([2, 3, 6]), np.array([1, 3, 4, 6]))
    assert list(zip(a.tolist(), b.tolist(), closed.tolist(), strict=True)) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, False), (2, 3, True)]


def test_segments():
    assert segments_of("a b  c\n d") == ["a", "b", " c\n d"]
    assert segments_of("a ") == ["a", ""] and segments_of(" a") == [" a"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD), max_size=40), min_size=1, max_size=6))
def test_texts_equal_the_plain_version(aligner, texts):
    measures, groups, owner, pairs, times = aligner.texts(texts)
    for i, text in enumerate(texts):
        own = {(int(p) // PAIR, int(p) % PAIR): int(n) for p, n in zip(pairs[owner == i], times[owner == i], strict=True)}
        expected = plain(aligner, text) or (0, 0, 0, "", {})
        assert (*measures[i, :3].tolist(), groups[i], own) == expected
        assert measures[i, 3] == sum(own.values())


@pytest.mark.parametrize("head_pairs", [1 << 20, 100, 0])
def test_alignment_equals_the_plain_version(spark, aligner, documents, head_pairs):
    rng = random.Random(2)
    odd = [(1000 + i, "".join(rng.choices(ODD, k=rng.randrange(60)))) for i in range(60)]
    texts = [*EDGE_TEXTS, *odd, (2000, "the same words"), (2001, "the same words"), (2002, "▁ lower one eighth"), (2003, "<|endoftext|> <s> </s> <unk>")]
    texts += [(3000 + r.doc_id, r.text) for r in documents.filter("doc_id < 40 and length(text) < 4000").collect()]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id long, text string, k string, copies int").repartition(5)
    found = by_id(align_tokenizers(df, *FILES, head_pairs=head_pairs))
    assert found == brute_force(aligner, texts)
    assert found[2000]["n_a"] and found[2003]["n_a"] and not found[2002]["n_links"]


def test_runs_of_a_million_characters(aligner):
    for text in (" " * 1_000_000, "a" * 100_000 + " \t" * 60_000):
        measures, groups, *_ = aligner.texts([text])
        expected = plain(aligner, text) or (0, 0, 0, "", {})
        assert (*measures[0, :3].tolist(), groups[0]) == expected[:4]


def test_alignment_of_no_rows(no_docs):
    assert align_tokenizers(no_docs, *FILES).count() == 0


def test_a_worker_forgets(aligner, monkeypatch):
    import siltworks.llm.token_alignment as module

    monkeypatch.setattr(module, "CACHE_ENTRIES", 3)
    for text in ("one two three four five", "six seven one two", "one two three four five"):
        measures, groups, *_ = aligner.texts([text])
        assert groups[0] == plain(aligner, text)[3]
