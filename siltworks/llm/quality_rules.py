"""Quality rules by tokeniser fertility.

Public vocabularies measure how a text falls into tokens: characters per token
under a piece vocabulary and a multilingual byte vocabulary, the share of tokens
that are single bytes because no piece fits, and the entropy of the tokens.
Ordinary prose of one language keeps within a narrow band of each; tables, code,
shouting and noise leave it. The bands are fences around the quartiles of all
documents of a language, or of a script where the language is unknown.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import CACHE_ENTRIES, Batches, arrow_type, by_size, made_once, mixed, parked, scan, shingles_in_order, texts_of

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURES = ["chars_per_piece", "chars_per_byte_token", "fallback_share", "token_entropy"]
SCHEMA = f"doc_id long, lang string, script string, {COUNTS}, {', '.join(m + ' double' for m in MEASURES)}"
#: Rules apart from the bands: fewest words, and most repeated words in a hundred.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Languages of at least one in so many documents are frequent.
FREQUENT = 1000
#: Bytes of text whose new words are measured together.
SLICE_BYTES = 4 << 20

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SPACE_BYTES = [_SPACES[i : i + 1] for i in range(len(_SPACES))]
# First code points of the larger blocks of letters.
_SCRIPTS = [(0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0x1100, "Hangul"), (0x1E00, "Latin"), (0x3040, "Kana"), (0x3400, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other")]


def script_of(text: str) -> str:
    """The script of the first letter."""
    for char in text:
        if char.isalpha():
            return next(name for start, name in reversed(_SCRIPTS) if ord(char) >= start)
    return "None"


class Fertility:
    """What the vocabularies make of words. Each known word has a number, under which tables hold its pieces and tokens."""

    def __init__(self, pieces_path: str, ranks_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.n_pieces = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.n_pieces)])
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.n_tokens = np.empty(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        if len(self.number) > CACHE_ENTRIES:
            self.forget()
        fresh = [w for w in words if w not in self.number]
        plain = [w.decode() for w in fresh]
        pieces = self.pieces.encode(plain, num_threads=1)
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(pieces), np.int32))
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))
        encode = self.encoding.encode_ordinary
        self.n_tokens = np.append(self.n_tokens, np.fromiter((len(encode(" " + w)) for w in plain), np.int64, len(plain)))

    def measures(self, texts: list[list[int]], chars: np.ndarray) -> list[np.ndarray]:
        """The four measures of each text, given as the numbers of its words."""
        lengths = np.array([len(t) for t in texts])
        words, owner = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(texts)), lengths)
        size = self.first[words + 1] - self.first[words]
        places = np.arange(size.sum()) + np.repeat(self.first[words] - (np.cumsum(size) - size), size)
        key, counts = np.unique(np.repeat(owner, size) * self.n_pieces + self.ids[places], return_counts=True)
        owner_of, piece = np.divmod(key, self.n_pieces)
        total = np.bincount(owner_of, counts, len(texts))
        n = np.maximum(total, 1)
        share = counts / n[owner_of]
        entropy = np.bincount(owner_of, -share * np.log2(share), len(texts)) / np.log2(np.maximum(total, 2))
        in_bytes = np.bincount(owner_of, counts * self.is_byte[piece], len(texts)) / n
        tokens = np.bincount(owner, self.n_tokens[words], len(texts))
        return [chars / n, chars / np.maximum(tokens, 1), in_bytes, entropy]


def fertility(pieces_path: str, ranks_path: str, pattern: str) -> Fertility:
    return made_once(("fertility", pieces_path, ranks_path), lambda: Fertility(pieces_path, ranks_path, pattern))


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    if len(numbers) < 4:
        return 0
    windows = shingles_in_order(mixed(numbers.astype(np.uint64)), 3)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift : len(numbers) - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts and fertility of every document, without a shuffle."""

    def run(batches: Batches) -> Batches:
        tool, out = fertility(pieces_path, ranks_path, pattern), arrow_type(SCHEMA)
        for batch in batches:
            texts = texts_of(batch)
            columns: list[list] = [[] for _ in range(len(out) - 2)]
            for first, last in by_size(texts, SLICE_BYTES):
                part = texts[first:last]
                words = [t.split() for t in part]
                tool.learn({w for own in words for w in own})
                numbers = [np.fromiter(map(tool.number.__getitem__, own), np.int64, len(own)) for own in words]
                plain = [t.decode() for t in part]
                n_words = [len(own) for own in words]
                chars = [len(p) - sum(map(t.count, _SPACE_BYTES)) for p, t in zip(plain, part, strict=True)]
                repeats = [repeated_words(own) for own in numbers]
                failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, r in zip(n_words, repeats, strict=True)]
                found = [
                    map(script_of, plain), n_words, chars, (len(_SYMBOLS.findall(t)) for t in part), map(duplicate_lines, part), repeats, failed,
                    *tool.measures(numbers, np.array(chars)),
                ]
                for column, values in zip(columns, found, strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string())]
                + [pa.array(c, f.type) for c, f in zip(columns, list(out)[2:], strict=True)],
                schema=out,
            )

    return scan(docs, {"doc_id": id_col, "lang": lang_col, "text": text_col}, run, SCHEMA)


def quality_rules(
    docs: DataFrame,
    pieces_path: str,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    width: float = 2.5,
    least_spread: float = 0.02,
    few_docs: int = 100,
    free_share: float = 0.03,
    free_bytes: int = 16,
) -> DataFrame:
    """Counts, base rule, fertility and verdict of every document.

    A document is kept if it passes the base rule and every measure lies within
    the fences of its language: quartiles of all documents that pass the base
    rule, widened by ``width`` times their distance, which counts as
    ``least_spread`` of the median at least, and more for short texts, whose
    measures scatter more, and for languages of few documents (by the root of 2
    at ``few_docs``), whose quartiles do. Documents without a language use the
    fences of all rows of their script. Up to ``free_share`` of a text's tokens
    or ``free_bytes`` of them may be single bytes whatever the fences say: a few
    rare characters in plain prose. A null or empty text has no words, fails the
    base rule and is not kept; repeated rows count as often as they come; a null
    language is unknown. Three-word windows are compared by 64-bit fingerprints.
    """
    measured = parked(measure(docs, pieces_path, ranks_path, pattern, id_col, text_col, lang_col), "fertility")
    levels = F.array(F.struct(F.lit("lang").alias("level"), F.col("lang").alias("band")), F.struct(F.lit("script").alias("level"), F.col("script").alias("band")))
    passing = measured.filter(~F.col("base_failed")).select(F.inline(levels), *MEASURES).filter("band is not null")
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(m) for m in MEASURES]
    bands = passing.groupBy("level", "band").agg(F.count("*").alias("docs"), *quartiles)
    few = F.sqrt(1 + few_docs / F.col("docs"))
    spread = lambda m: few * F.greatest(F.col(m)[2] - F.col(m)[0], least_spread * F.abs(F.col(m)[1]), F.lit(1e-3))
    sides = [F.struct(F.col(m)[0].alias("low"), F.col(m)[2].alias("high"), spread(m).alias("spread")).alias(m) for m in MEASURES]
    fences = parked(bands.select("level", "band", "docs", F.struct(*sides).alias("fence")), "fences")
    # Scripts are few and so are languages of a fixed share of the documents: both travel to
    # the documents. Rare languages may be any number, but no one of them has many rows.
    scripts, langs = fences.filter("level = 'script'"), fences.filter("level = 'lang'")
    least = (scripts.agg(F.sum("docs")).first()[0] or 0) / FREQUENT
    side = lambda bands, name: bands.select(F.col("band").alias(f"{name}_key"), F.col("fence").alias(name))
    by_lang, by_script = side(langs.filter(F.col("docs") >= least), "by_lang"), side(scripts, "by_script")
    met = measured.join(F.broadcast(by_lang), F.col("lang") == F.col("by_lang_key"), "left")
    met = met.join(F.broadcast(by_script), F.col("lang").isNull() & (F.col("script") == F.col("by_script_key")), "left")
    columns = [*measured.columns, F.coalesce("by_lang", "by_script").alias("fence")]
    is_open = ~F.col("base_failed") & F.col("by_lang_key").isNull() & F.col("lang").isNotNull()
    rare = side(langs.filter(F.col("docs") < least), "by_rare")
    out = met.filter(~is_open).select(*columns).unionByName(
        met.filter(is_open).join(rare, F.col("lang") == F.col("by_rare_key"), "left").select(*measured.columns, F.col("by_rare").alias("fence"))
    )
    fence = F.col("fence")
    scatter = width * F.sqrt(1 + 100 / F.greatest("n_words", F.lit(1)))
    # Byte tokens are their share of all tokens, which are characters by characters per token.
    free = (F.col("fallback_share") <= free_share) | (F.col("fallback_share") * F.col("word_chars") <= free_bytes * F.col("chars_per_piece"))
    within = F.lit(True)
    for m in MEASURES:
        if m != "fallback_share":
            within &= F.col(m) >= fence[m]["low"] - scatter * fence[m]["spread"]
        if m != "token_entropy":
            below = F.col(m) <= fence[m]["high"] + scatter * fence[m]["spread"]
            within &= below | free if m == "fallback_share" else below
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *MEASURES
    )
