"""Toxicity by maximum-scoring segments of token log-odds.

Training counts in how many toxic and clean documents each token stands and
turns the counts into log-odds with an informative Dirichlet prior.  Tokens are
words and, for words that training never saw, word beginnings.  Scoring walks
each whole text once: tokens with significant positive log-odds add them, every
other token, whatever its log-odds, costs the same drift.  A token adds a k-th of
its log-odds when it stands for the k-th time with less than ``NEAR`` tokens
between.  All maximal segments of positive sum are found in time linear in the
tokens.  In clean text of ``n`` tokens the best segment exceeds ``x`` with the
probability ``1 - exp(-scale * n * exp(-rate * x))``; both parameters of this
extreme-value law are fitted to the best segments of the clean training texts,
whatever their lengths.  It gives each segment a significance in its text's
length; the significant ones are summed and mapped to a probability by a
logistic fit on the training rows.

What training uses is bounded by ``max_train`` labelled rows of each class
(drawn by a hash of the id) and ``max_terms`` tokens; scoring reads all.

Defined results
---------------
* null or empty text, or one without words: no segment, the score of clean text;
* labels that are null, or whose id has no document, teach nothing; repeated
  texts teach once; without labels of both classes every score is the base rate;
* null ids are held out; repeated rows get equal scores; an empty table gives an
  empty result; other columns pass through ``score_documents`` untouched, and a
  column named as the result is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import stage

WORDS = re.compile(r"\w+")
#: Lengths of word beginnings that stand in for unseen words, longest first.
STEMS = (6, 5, 4)
#: A segment is significant if clean text of the same length has fewer as good ones than this, on average.
EXPECTED = 0.01
#: Repeats of a token that are nearer than so many tokens add less and less.
NEAR = 50
_MEMO = 200_000
RESULT = "struct<score:double,segments:array<struct<start:int,end:int,score:double>>>"


@dataclass(frozen=True)
class ToxicityModel:
    """Token scores with their drift, the extreme-value law and the logistic map."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    drift: float = 0.25
    rate: float = 1.0
    scale: float = 0.1
    intercept: float = 0.0
    slope: float = 0.0


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def document_tokens(text: str) -> set[str]:
    """Words of a text, and its word beginnings (marked with a tilde)."""
    words = set(WORDS.findall(text.lower()))
    return words | {w[:n] + "~" for w in words for n in STEMS if len(w) > n}


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a token line, in time linear in ``hits``.

    ``hits`` are positions with positive scores in order; every token between
    costs ``drift``.  Candidates form a list in which each new one is joined to
    the nearest earlier one that starts lower, as long as joining raises it.
    Every candidate knows the nearest earlier one that starts lower than itself,
    so those between are never looked at again.
    """
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest earlier one that starts lower
    total, last = 0.0, -1
    for position, score in hits:
        total -= drift * (position - last - 1)
        low, high, first, end = total, total + score, position, position
        total, last = high, position
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, end, j))
                break
            low, _, first, _, before = found[j]
            del found[j:]
            j = before
    return [(first, end, high - low) for low, high, first, end, _ in found]


class Scorer:
    """Finds segments and scores of texts under a model."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.memo: dict[str, float] = {}

    def token_score(self, word: str) -> float:
        score = self.memo.get(word)
        if score is None:
            score = self.model.words.get(word, math.nan)
            if math.isnan(score):
                score = next((self.model.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.model.stems), 0.0)
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = score
        return score

    def maximal(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal segments of a text (positions of first and last word, score), and its number of words."""
        if not text:
            return [], 0
        get = self.token_score
        hits, n, seen = [], 0, {}
        for n, word in enumerate(WORDS.findall(text.lower()), 1):
            score = get(word)
            if score > 0:
                at, times = seen.get(word, (-NEAR, 0))
                times = times + 1 if n - at < NEAR else 1
                seen[word] = n, times
                hits.append((n - 1, score / times))
        return maximal_segments(hits, self.model.drift), n

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], float]:
        """Significant segments (word positions, end exclusive) and their summed significance."""
        if not (self.model.words or self.model.stems):
            return [], 0.0
        maximal, n = self.maximal(text)
        base = math.log(max(self.model.scale * n, 1e-9) / EXPECTED) if n else 0.0
        out, evidence = [], 0.0
        for first, last, score in maximal:
            surprise = self.model.rate * score - base  # how far the expected number of such segments stays below the limit
            if surprise > 0:
                out.append((first, last + 1, score))
                evidence += surprise
        return out, evidence

    def probability(self, evidence: float) -> float:
        x = self.model.intercept + self.model.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        tokens = list(set(counts[0]) | set(counts[1]))
        out = pa.RecordBatch.from_pydict({"token": tokens, "clean": [counts[0][t] for t in tokens], "toxic": [counts[1][t] for t in tokens]}, pa.schema([("token", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))
        counts[0].clear(), counts[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[1 if toxic.as_py() else 0].update(document_tokens(text.as_py() or ""))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
    yield flush()


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> DataFrame | None:
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, max_train / sizes[1])).otherwise(min(1.0, max_train / sizes[0]))
    # About 2 * max_train ids: a bound that does not depend on the tables.
    chosen = F.broadcast(known.where(draw < share))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id").select("text", "toxic")
    once = rows.where(F.col("text").isNotNull()).groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    # Read five times below; written once, it is at most about 2 * max_train rows.
    return stage(once, "toxicity-sample")


def extreme_value_law(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Rate and scale that make the best segments of clean texts likeliest, by the texts' lengths.

    A text whose best segment is 0 had none, which has the probability
    ``exp(-scale * n)``.  For a given rate the likeliest scale is known, and the
    rate is found on a grid of ratios.
    """
    best, lengths = best[lengths > 0], lengths[lengths > 0].astype(float)
    some = best > 0
    if not some.any():
        return 1.0, 0.5 / max(lengths.sum(), 1.0)
    rates = 0.02 * 1.05 ** np.arange(120)
    scales = np.array([some.sum() / (lengths * np.exp(-r * best)).sum() for r in rates])
    likelihood = [some.sum() * (math.log(k) + math.log(r) - 1) - r * best[some].sum() for r, k in zip(rates, scales, strict=True)]
    at = int(np.argmax(likelihood))
    return float(rates[at]), float(scales[at])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a small ridge on the slope."""
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - np.array([0.0, 0.01]) * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.01])
        move = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = 10_000,
    max_terms: int = 50_000,
    prior: float = 50.0,
    min_z: float = 4.0,
    drift: float = 0.25,
) -> ToxicityModel:
    """Learn from labelled documents that are not held out."""
    sample = _sample(docs, labels, id_col, text_col, max_train)
    if sample is None:
        return ToxicityModel()
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel()
    n1, n0 = float(sizes[1]), float(sizes[0])
    counts = sample.mapInArrow(_counts, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    alpha = F.lit(prior) * (F.col("clean") + F.col("toxic")) / (n0 + n1)
    a1, a0 = F.col("toxic") + alpha, F.col("clean") + alpha
    delta = F.log(a1 / F.greatest(F.lit(n1 + prior) - a1, F.lit(0.5))) - F.log(a0 / F.greatest(F.lit(n0 + prior) - a0, F.lit(0.5)))
    scored = counts.where(F.col("toxic") >= 3).withColumn("delta", delta).withColumn("z", delta / F.sqrt(1 / a1 + 1 / a0)).withColumn("share", a0 / (n0 + prior))
    terms = scored.where((F.col("z") >= min_z) & (F.col("delta") > 4 * drift)).orderBy(F.desc("z"), "token").limit(max_terms).collect()
    words = {r["token"]: r["delta"] for r in terms if not r["token"].endswith("~")}
    stems = {r["token"][:-1]: r["delta"] for r in terms if r["token"].endswith("~")}
    bare = ToxicityModel(words, stems, drift)
    # One row a training text: at most 2 * max_train, about.
    seen = sample.mapInArrow(_best_segments(bare), "toxic int, n long, best double").toPandas()
    clean = seen[seen["toxic"] == 0]
    rate, scale = extreme_value_law(clean["best"].to_numpy(float), clean["n"].to_numpy(float))
    model = replace(bare, rate=rate, scale=scale)
    rows = sample.select("toxic", _evidence_of(model)("text").alias("evidence")).toPandas()
    intercept, slope = _logistic(np.log1p(rows["evidence"].to_numpy(float)), rows["toxic"].to_numpy(float), np.ones(len(rows)))
    return replace(model, intercept=intercept, slope=slope)


def _best_segments(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.maximal(t.as_py()) for t in batch["text"]]
            best = [max((s for _, _, s in segments), default=0.0) for segments, _ in found]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([n for _, n in found], pa.int64()), pa.array(best, pa.float64())], names=["toxic", "n", "best"])

    return run


def _evidence_of(model: ToxicityModel):
    def evidence(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in texts:
            yield pa.array([scorer.segments(t.as_py())[1] for t in batch], pa.float64())

    evidence.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(evidence, "double")


def score_documents(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out``: the score and the significant segments (word positions)."""
    if out in docs.columns:
        raise ValueError(f"the input has a column {out!r} of its own")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    segment = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in texts:
            rows = [scorer.segments(t.as_py()) for t in batch]
            scores = pa.array([scorer.probability(e) for _, e in rows], pa.float64())
            segments = pa.array([[{"start": a, "end": b, "score": s} for a, b, s in g] for g, _ in rows], segment)
            yield pa.StructArray.from_arrays([scores, segments], ["score", "segments"])

    score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(score, RESULT)(F.col(text_col)))
