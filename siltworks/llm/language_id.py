"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed runs of 2 to 4 bytes over
lower-case letters and word ends. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows; the
scores are calibrated by a temperature on rows of that sample not trained on.
For prediction the two layers collapse into one table of scores per bucket.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import Batches, arrow_type, by_size, scan, texts_of

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
UNKNOWN = "und"
BUCKETS = 1 << 15
SIZES = (2, 3, 4)
#: Bytes of text hashed at once; bounds the memory of a task.
SLICE_BYTES = 1 << 20
#: Ids kept for the choice of each training row.
SPARE = 4

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def letters_of(text: bytes) -> bytes:
    """Lower-case letters with one space between and around words; empty if there is no letter."""
    plain = text.decode()
    if not any(map(str.isalpha, plain)):
        return b""
    return f" {_NOT_LETTERS.sub(' ', plain.lower()).strip()} ".encode()


def buckets_of(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the run of ``size`` bytes that begins at each place but the last ones."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.full(n, size * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for i in range(size):
        total = (total ^ data[i : n + i]) * _MULTIPLIERS[i]
    total ^= total >> np.uint32(15)
    return (total * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)


def counts_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a normalised text and how often each comes."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    found = np.concatenate([buckets_of(data, s) for s in SIZES])
    return np.unique(found, return_counts=True)


@dataclass
class LanguageModel:
    """Scores of each bucket for each language, and the temperature and doubt that calibrate them."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    doubt: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Scores of normalised, non-empty texts; long ones are summed slice by slice."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= SLICE_BYTES):
                group.append(at)
                size += len(texts[at])
                at += 1
            if size > SLICE_BYTES:
                text, step = texts[group[0]], SLICE_BYTES
                parts = [text[i : i + step + max(SIZES) - 1] for i in range(0, len(text), step)]
                owners, steps = [group[0]] * len(parts), [min(step, len(text) - i) for i in range(0, len(text), step)]
                for part, owner, own in zip(parts, owners, steps, strict=True):
                    self._add(sums, counts, [part], [owner], own)
            else:
                self._add(sums, counts, [texts[i] for i in group], group, None)
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def _add(self, sums: np.ndarray, counts: np.ndarray, parts: list[bytes], owners: list[int], places: int | None) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        for size in SIZES:
            scores = self.table[buckets_of(data, size)]
            if not len(scores):
                continue
            running = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
            until = np.maximum(ends - size + 1, starts) if places is None else np.minimum(starts + places, ends - size + 1)
            until = np.minimum(until, len(scores))
            until = np.maximum(until, np.minimum(starts, len(scores)))
            begin = np.minimum(starts, len(scores))
            sums[owners] += running[until] - running[begin]
            counts[owners] += until - begin

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return (1 - self.doubt) * scaled / scaled.sum(axis=1, keepdims=True) + self.doubt / scaled.shape[1]


def train(
    examples: list[tuple[str, np.ndarray, np.ndarray, bool]],
    dim: int = 16,
    epochs: int = 8,
    rate: float = 1.0,
    seed: int = 11,
) -> LanguageModel:
    """Fit embeddings and softmax on (language, buckets, counts, for calibration) examples."""
    languages = sorted({e[0] for e in examples})
    index = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    fit, rest = [e for e in examples if not e[3]], [e for e in examples if e[3]]
    steps = max(1, epochs * len(fit))
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            name, buckets, counts, _ = fit[k]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[buckets]
            scores = mean @ weights + bias
            wrong = np.exp(scores - scores.max())
            wrong /= wrong.sum()
            wrong[index[name]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = weights @ wrong
            weights -= step * np.outer(mean, wrong)
            bias -= step * 0.1 * wrong
            # A bucket holds a small share of a text, so embeddings take longer steps.
            vectors[buckets] -= 20 * step * share[:, None] * back
            done += 1
    model = LanguageModel(languages, (vectors @ weights).astype(np.float32), bias.astype(np.float64))
    if rest:
        logits = np.array([(c / c.sum()) @ model.table[b] + model.bias for _, b, c, _ in rest])
        truth = np.array([index[e[0]] for e in rest])
        # Errors however sure the model is, such as wrong labels: the share to be expected.
        model.doubt = float(((logits.argmax(axis=1) != truth).sum() + 1) / (len(truth) + 2))
        losses = {}
        for temperature in np.geomspace(0.25, 8, 41):
            model.temperature = float(temperature)
            losses[model.temperature] = -np.log(model.probabilities(logits)[np.arange(len(truth)), truth] + 1e-12).mean()
        # A little warmer than the best: the calibration rows are few.
        model.temperature = 1.1 * min(losses, key=losses.get)
    return model


def fit_language_model(
    docs: DataFrame,
    trainable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    max_languages: int = 200,
) -> LanguageModel | None:
    """Train on at most ``per_language`` labelled rows of each language, those of the smallest hash of their id.

    The ``max_languages`` commonest languages are learned. Whole texts and two short cuts of each become examples, counted into buckets
    on the executors; the driver gets bucket counts only. A fifth of the rows
    calibrates. Rows without an id are not learned from; of rows that repeat an id and
    a language, the smallest text is, so the model does not depend on the order of rows.
    A task that picks meets about ``SPARE`` times ``per_language`` ids, hot languages
    included. None without labelled rows that have a letter.
    """
    chance = F.xxhash64(F.lit(8), F.col("doc_id"))
    order = Window.partitionBy("lang").orderBy("chance", "doc_id")
    own = docs.filter(trainable).select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    labelled = own.filter("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", chance.alias("chance"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("doc_id").alias("ids"))
    most = sizes.orderBy(F.desc("rows"), "lang").limit(max_languages).collect()
    if not most:
        return None
    # Hashes are even, so those below this bound are a few times per_language ids, however many a language has.
    shares = {r.lang: SPARE * per_language / max(r.ids, 1) for r in most}
    bounds = [(lang, 2**63 - 1 if share >= 1 else int(2**64 * share) - 2**63) for lang, share in shares.items()]
    below = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    few = labelled.join(below, "lang").filter("chance <= bound").select("lang", "doc_id", "chance").distinct()
    picked = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    ids = sorted((r.doc_id, r.lang) for r in picked.collect())
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, lang string")
    sample = own.join(F.broadcast(wanted), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    schema = "doc_id long, lang string, part int, buckets binary, counts binary"

    def count(batches: Batches) -> Batches:
        out = arrow_type(schema)
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                letters = letters_of(text)
                words = letters.split()
                cuts = [letters] + ([b" " + b" ".join(words[i : i + n]) + b" " for i, n in ((len(words) // 3, 8), (len(words) // 2, 2))] if len(words) > 12 else [])
                for part, cut in enumerate(cuts if letters else []):
                    buckets, counts = counts_of(cut)
                    rows.append((doc_id, lang, part, buckets.astype("<i4").tobytes(), counts.astype("<i4").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    counted = scan(sample, {"doc_id": "doc_id", "lang": "lang", "text": "text"}, count, schema)
    rows = {(r.doc_id, r.lang, r.part): r for r in counted.toLocalIterator()}
    examples = [
        (lang, np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4"), doc_id % 5 == 0)
        for (doc_id, lang, _), r in sorted(rows.items(), key=lambda x: tuple(map(str, x[0])))
    ]
    return train(examples) if examples else None


def predicted(texts: list[bytes], model: LanguageModel | None) -> list[tuple[str, float]]:
    """(language, calibrated probability) of whole texts."""
    out = []
    for first, last in by_size(texts, SLICE_BYTES):
        letters = [letters_of(t) for t in texts[first:last]]
        some = [i for i, x in enumerate(letters) if x and model]
        best = [(UNKNOWN, 0.0)] * len(letters)
        if some:
            found = model.probabilities(model.logits([letters[i] for i in some]))
            for i, k, p in zip(some, found.argmax(axis=1), found.max(axis=1), strict=True):
                best[i] = (model.languages[k], min(float(p), 1.0))
        out += best
    return out


def accepted(prediction: tuple[str, float], min_score: float) -> bool:
    """Scores are calibrated: below a half, a prediction is more likely wrong than right."""
    return prediction[0] != UNKNOWN and prediction[1] >= min_score


def language_id(
    docs: DataFrame,
    model: LanguageModel | None,
    is_held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_score: float = 0.5,
) -> DataFrame:
    """The predicted language of every whole text with its calibrated probability.

    A null text, a text without a letter, and every text without a model get
    ``und`` with score 0. ``accepted`` is false for those and below
    ``min_score``. Repeated rows get equal answers. No shuffle.
    """

    def run(batches: Batches) -> Batches:
        out = arrow_type(SCHEMA)
        for batch in batches:
            found = predicted(texts_of(batch), model)
            names, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([accepted(f, min_score) for f in found], pa.bool_())],
                schema=out,
            )

    picked = docs.select(docs[id_col].alias("doc_id"), is_held_out.alias("held_out"), docs[text_col].alias("text"))
    return scan(picked, {c: c for c in picked.columns}, run, SCHEMA)


def keep_accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns as they are; rows pass through without a shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([accepted(p, min_score) for p in predicted(texts, model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
