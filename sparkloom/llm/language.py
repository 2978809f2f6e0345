"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of machine words serves all languages: bit ``l`` of a row belongs to
the Bloom filter of language ``l``.  Looking an n-gram up reads a few rows and
ANDs them; the result is the bitmask of all languages that contain the n-gram.
A text counts, for each language, the n-grams whose mask has its bit.  From the
count goes what false positives of that language's filter add on average; the
largest corrected count decides.

The filters are fitted on about ``per_lang`` documents of each language, drawn
by a hash of the text, and hold the n-grams of at least ``min_share`` of a
language's n-grams, so at most ``1 / min_share`` a language and size.

Defined results
---------------
* null text, or text without a letter: ``und`` with score 0;
* equal corrected counts: the language that is first by code point;
* a text whose n-grams no filter knows: the first language, score 0;
* no labelled document at all: ``und`` for every row;
* repeated rows get equal predictions; an empty table gives an empty result;
  other columns pass through ``identify`` untouched, and a column named as the
  result is an error;
* more than ``max_langs`` languages are an error, as their filters would not fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4)
ROWS = 1 << 19
PROBES = 4
UNKNOWN = "und"
#: N-grams hashed at once.
PIECE = 1 << 18
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


@dataclass(frozen=True)
class LanguageModel:
    """Languages and the bit-sliced table: ``ROWS`` rows, one 64-bit word for every 64 languages."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.uint64))
    false_positive: np.ndarray = field(default_factory=lambda: np.zeros(0))


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, by pieces; letters inside, at most one end beside a word.

    A piece holds the n-grams that start in it, so the pieces together hold each once.
    """
    table = _letters()
    text = f" {text.lower()} "
    for start in range(0, len(text), PIECE):
        code = np.frombuffer(text[start : start + PIECE + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[code]
        code = np.where(letter, code, 32).astype(np.uint64)
        out = []
        for n in SIZES:
            m = min(PIECE, len(code) - n + 1)
            if m <= 0:
                continue
            inside = np.ones(m, bool)
            for k in range(1, n - 1):
                inside &= letter[k : k + m]
            inside &= letter[:m] | letter[n - 1 : n - 1 + m]
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ code[k : k + m]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B9)
            h ^= h >> np.uint64(29)
            out.append((h * _MULTIPLIERS[0])[inside])
        if out:
            yield np.concatenate(out)


def probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the table to read for each hash."""
    for i in range(PROBES):
        h = hashes * _MULTIPLIERS[i]
        yield ((h ^ (h >> np.uint64(31))) & np.uint64(ROWS - 1)).astype(np.int64)


def masks(model: LanguageModel, hashes: np.ndarray) -> np.ndarray:
    """Bitmask of the languages that contain each n-gram."""
    found = None
    for rows in probes(hashes):
        found = model.table[rows] if found is None else found & model.table[rows]
    return found


def decide(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Language of a text and how far it leads: its corrected count against that of the next."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    counts, total = np.zeros(len(model.languages)), 0
    for hashes in ngram_hashes(text):
        found = masks(model, hashes)
        counts += [np.count_nonzero(found[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(model.languages))]
        total += len(hashes)
    corrected = np.maximum(0.0, (counts - total * model.false_positive) / (1 - model.false_positive))
    best = int(corrected.argmax())
    if corrected[best] <= 0:
        return model.languages[0], 0.0
    second = np.delete(corrected, best).max() if len(corrected) > 1 else 0.0
    return model.languages[best], float(corrected[best] / (corrected[best] + second))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush(by_lang: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for lang, parts in by_lang.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            for grams in ngram_hashes(text.as_py() or ""):
                by_lang.setdefault(lang.as_py(), []).append(grams)
                size += len(grams)
                if size > 4_000_000:
                    yield from flush(by_lang)
                    by_lang, size = {}, 0
        yield from flush(by_lang)


def fit_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_lang: int = 2000, min_share: float = 2e-5, max_langs: int = 4096) -> LanguageModel:
    """Fit the filters on labelled documents; rows with a null text or language teach nothing."""
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where("n >= 1")
    languages = [r["lang"] for r in sizes.orderBy("lang").limit(max_langs + 1).collect()]
    if len(languages) > max_langs:
        raise ValueError(f"more than {max_langs} languages: their filters take {ROWS // 8} bytes each on every worker")
    if not languages:
        return LanguageModel()
    known = known.join(F.broadcast(sizes), "lang")  # at most max_langs rows
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "text"), F.lit(1 << 30)) / float(1 << 30)
    counts = known.where(draw < share).select("text", "lang").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * min_share))
    grams = kept.select("lang", "gram").toPandas()  # at most 1 / min_share a language
    table = np.zeros((ROWS, -(-len(languages) // 64)), np.uint64)
    for i, lang in enumerate(languages):
        hashes = grams.loc[grams["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for rows in probes(hashes):
            np.bitwise_or.at(table[:, i // 64], rows, np.uint64(1 << (i % 64)))
    fill = np.array([np.count_nonzero(table[:, i // 64] & np.uint64(1 << (i % 64))) / ROWS for i in range(len(languages))])
    return LanguageModel(languages, table, fill**PROBES)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a column ``out``: ``lang`` and ``score``."""
    if out in docs.columns:
        raise ValueError(f"the input has a column {out!r} of its own")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [decide(shared.value, t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([l for l, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64())], ["lang", "score"])

    predict.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(predict, "struct<lang:string,score:double>")(F.col(text_col)))
