"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

Templates are grouped by size. Windows of a group hold twice its longest
occurrence and start one such length apart, so that every occurrence lies whole
in some window. A band is one minimum: a window and a template that share a part
J of their shingles agree in one of n bands with probability 1 - (1 - J)^n. The
size of a window bounds J from below for every occurrence the scan must find,
and n follows from the wanted probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltworks.llm.common import Batches, WordHashes, arrow_type, by_size, mixed, scan, shingles_in_order, texts_of

SCHEMA = "doc_id long, license string, containment double, first_word long, n_words long, n_windows long"
SHINGLE = 5
#: Sizes of templates in one group differ by this factor at most.
GROUP_FACTOR = 2
#: An occurrence may be longer than its template by this factor, for words put in between.
STRETCH = 1.25
#: Bytes of text whose shingles are scanned together.
SLICE_BYTES = 4 << 20

_EDGES = b".,;:!?\"'()[]{}<>*#/-_"


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words without punctuation at their ends; words of punctuation alone are left out."""
    return [w for w in (word.strip(_EDGES) for word in text.lower().split()) if w]


@dataclass
class Group:
    """Templates of similar size: names, sorted distinct shingles, minima per band."""

    names: list[str]
    shingles: list[np.ndarray]
    step: int
    minima: np.ndarray


@dataclass
class Templates:
    groups: list[Group]
    salts: np.ndarray


def bands_for(smallest: int, step: int, containment: float, certainty: float) -> int:
    """Bands by which a window of ``2 * step`` shingles is retrieved with ``certainty``."""
    shared = containment * smallest
    jaccard = shared / (2 * step + smallest - shared)
    return math.ceil(math.log(1 - certainty) / math.log(1 - jaccard))


def minimum_keys(shingles: np.ndarray, salt: np.uint32) -> np.ndarray:
    """An order of shingles for each salt; 32 bits suffice to propose windows."""
    return (shingles ^ salt) * np.uint32(0x9E3779B1)


def short(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def build_templates(texts: dict[str, str], containment: float, certainty: float) -> Templates:
    hashes = WordHashes()
    found = {name: np.unique(shingles_in_order(hashes.of(plain_words(t.encode())), SHINGLE)) for name, t in sorted(texts.items())}
    by_size = sorted((n for n in found if len(found[n])), key=lambda n: (len(found[n]), n))
    groups: list[list[str]] = []
    for name in by_size:
        if groups and len(found[name]) <= GROUP_FACTOR * len(found[groups[-1][0]]):
            groups[-1].append(name)
        else:
            groups.append([name])
    steps = [math.ceil(STRETCH * len(found[g[-1]])) for g in groups]
    # Multiples of the first, so that the minima of its windows give those of the others.
    steps = [steps[0] * math.ceil(s / steps[0]) for s in steps]
    n_bands = max((bands_for(len(found[g[0]]), s, containment, certainty) for g, s in zip(groups, steps, strict=True)), default=0)
    salts = mixed(np.arange(1, n_bands + 1, dtype=np.uint64), 77).astype(np.uint32)
    return Templates(
        [
            Group(g, [found[n] for n in g], s, np.array([[minimum_keys(short(found[n]), salt).min() for n in g] for salt in salts]))
            for g, s in zip(groups, steps, strict=True)
        ],
        salts,
    )


def window_candidates(shingles: np.ndarray, templates: Templates) -> set[tuple[int, int, int]]:
    """(group, template, window) wherever a window and a template agree in a band."""
    found: set[tuple[int, int, int]] = set()
    base, keys_of = templates.groups[0].step, short(shingles)
    firsts = np.arange(0, len(shingles), base)
    starts = [np.arange(0, len(firsts), group.step // base) for group in templates.groups]
    for band, salt in enumerate(templates.salts):
        fine = np.minimum.reduceat(minimum_keys(keys_of, salt), firsts)
        for g, group in enumerate(templates.groups):
            minima = np.minimum.reduceat(fine, starts[g]) if g else fine
            windows = np.minimum(minima, np.append(minima[1:], minima[-1]))
            for t, wanted in enumerate(group.minima[band]):
                found.update((g, t, int(w)) for w in np.flatnonzero(windows == wanted))
    return found


def matches(texts: list[bytes], hashes: WordHashes, templates: Templates, containment: float) -> list[tuple]:
    """(text, license, best containment, first word and words of its best window, windows that match).

    The shingles of all texts lie end to end and share their windows; what a
    window holds is verified text by text.
    """
    own = [plain_words(t) for t in texts]
    runs = [shingles_in_order(hashes.of(words), SHINGLE) for words in own]
    ends = np.cumsum([len(r) for r in runs])
    shingles = np.concatenate(runs) if runs else np.empty(0, np.uint64)
    if not len(shingles) or not templates.groups:
        return []
    best: dict[tuple[int, int, int], tuple[float, int, int, int]] = {}
    for g, t, w in sorted(window_candidates(shingles, templates)):
        group = templates.groups[g]
        wanted, first = group.shingles[t], w * group.step
        window = shingles[first : first + 2 * group.step]
        hits = first + np.flatnonzero(np.isin(window, wanted))
        owners = np.searchsorted(ends, hits, side="right")
        for text in np.unique(owners):
            places = hits[owners == text]
            share = len(np.unique(shingles[places])) / len(wanted)
            if share >= containment - 1e-12:
                start = int(ends[text] - len(runs[text]))
                span = (share, int(places[0]) - start, int(places[-1] - places[0]) + min(SHINGLE, len(own[text])))
                old = best.get((int(text), g, t), (0.0, 0, 0, 0))
                best[int(text), g, t] = (*(span if share > old[0] else old[:3]), old[3] + 1)
    # Notices that differ in a version or a clause all match: the one that explains most of the text stays.
    found: dict[int, list[tuple[int, float, int, int]]] = {}
    for (text, g, t), (share, start, n_words, _) in best.items():
        found.setdefault(text, []).append((round(share * len(templates.groups[g].shingles[t])), share, start, n_words))
    out = []
    for (text, g, t), (share, start, n_words, windows) in sorted(best.items()):
        own = (round(share * len(templates.groups[g].shingles[t])), share)
        if not any(v[:2] > own and v[2] < start + n_words and start < v[2] + v[3] for v in found[text]):
            out.append((text, templates.groups[g].names[t], share, start, n_words, windows))
    return out


def license_scan(
    docs: DataFrame,
    texts: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = 0.8,
    certainty: float = 0.9999,
) -> DataFrame:
    """Licenses whose notices a text contains, one row for each text and license.

    ``containment`` is the least share of a template's distinct five-word
    shingles in one window; a template of under five words is one shingle. An
    occurrence inside one window is retrieved with probability ``certainty`` at
    least; verification is exact. Words are compared in lower case without
    punctuation at their ends. Of overlapping matches the one with most shingles in the text stays, of equals the one of
    highest containment, all of them if equal in both. The best
    window's matching words are reported, the earliest of equals, and the number
    of windows that match. Null and empty texts have no licenses; repeated rows
    give repeated matches. The templates are few and travel with the job; texts
    are scanned whole, without a shuffle.
    """
    templates = build_templates(texts, containment, certainty)

    def run(batches: Batches) -> Batches:
        hashes, out = WordHashes(), arrow_type(SCHEMA)
        for batch in batches:
            doc_ids, texts, rows = batch.column("doc_id").cast(pa.int64()).to_pylist(), texts_of(batch), []
            for first, last in by_size(texts, SLICE_BYTES):
                rows += [(doc_ids[first + i], *match) for i, *match in matches(texts[first:last], hashes, templates, containment)]
            columns = list(zip(*rows, strict=True)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return scan(docs, {"doc_id": id_col, "text": text_col}, run, SCHEMA)
