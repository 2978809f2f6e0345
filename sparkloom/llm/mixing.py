"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target in words.  A document of a source is wanted
``min(max_repeat, c * weight)`` times, where ``c`` is such that the words wanted
of the source are its target.  The whole part are certain copies; the fraction
that is left is the document's inclusion probability ``p``.  Each document draws
a uniform number ``u`` and is ranked by the Pareto key
``(u / (1 - u)) / (p / (1 - p))``; the documents with the smallest keys enter
until the words that are left are taken.

The weight of a document is 1 over the square root of its words, so that sizes
count and long documents are repeated less, or a column's value.  Weights are
rounded down to powers of ``2 ** (1 / STEPS)``; documents of a source with equal
rounded weight are a *class* with one ``p``.

The cut of a source is found without sorting the source: keys are counted in a
fixed number of buckets, and the bucket that holds the cut is counted again in
finer ones until it holds few rows; only those are ordered.  What reaches the
driver is one row a source and class.

Defined results
---------------
* null or empty text: size 0, nothing taken, the row stays in the result;
* null source: a source of its own, last in the order;
* null ids: allowed, the draw then depends on the text alone;
* a weight that is null, not finite or not positive counts as the smallest one;
* repeated rows draw the same number and are taken or left together;
* more than ``MAX_SOURCES`` sources are an error: targets depend on all sources
  in order, and their table is sent to every executor;
* empty tables give an empty result; extra columns pass through ``expand``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the Pareto key, of which each count of buckets looks at ``BUCKET_BITS`` more.
KEY_BITS = 48
BUCKET_BITS = 12
#: Rows of a source that are ordered to find its cut.
ORDERED = 10_000
#: Classes of weights in a factor of 2, and the largest exponent of 2.
STEPS = 4
EXPONENT = 40
#: The targets travel as one literal table; more sources than this are refused.
MAX_SOURCES = 100_000

_SHARES = "array<struct<share_source:string,share_class:int,source_size:long,target:double,whole:int,odds:double>>"
_CUTS = "array<struct<cut_source:string,cut_key:long>>"


@dataclass(frozen=True)
class SourceCut:
    """What one source gives: size, target, copies and inclusion odds by class, and the largest key that enters."""

    source: str | None
    size: int
    target: float
    classes: tuple[tuple[int, int, float], ...] = ()  # class, whole copies, odds
    key: int = -1


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_draw(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def source_targets(
    sizes: dict[str | None, int],
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_repeat: float = 3.0,
) -> dict[str | None, float]:
    """Words that each source should give.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` of all words.  A target stops at ``max_repeat`` times its source;
    what is above goes to the others by weight until no target is above.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left = share * sum(sizes.values())
    open_, out = list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if total > 0 and left * weight[s] / total >= max_repeat * sizes[s]]
        if not full:
            out.update({s: left * weight[s] / total if total > 0 else 0.0 for s in open_})
            break
        for s in full:
            out[s] = max_repeat * sizes[s]
        left = max(0.0, left - sum(out[s] for s in full))
        open_ = [s for s in open_ if s not in set(full)]
    return out


def factor(by_class: dict[int, int], target: float, max_repeat: float) -> float:
    """The ``c`` for which ``min(max_repeat, c * weight)`` of every class's words are ``target`` words."""
    left, out = target, 0.0
    words = sorted(((2 ** (k / STEPS), n) for k, n in by_class.items() if n), reverse=True)
    for i, (weight, n) in enumerate(words):
        rest = sum(w * m for w, m in words[i:])
        out = left / rest
        if out * weight <= max_repeat:
            return out
        left = max(0.0, left - max_repeat * n)  # this class is full
        out = max_repeat / weight
    return out


def slim_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, weight_col: str | None = None) -> DataFrame:
    """What planning needs of each document: source, size in words, draw and class of weight, as ``_id, _source, _size, _u, _class``."""
    size = word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("_size"), *_drawn(docs, id_col, text_col, seed, weight_col))
    return rows


def _drawn(docs: DataFrame, id_col: str, text_col: str, seed: int, weight_col: str | None) -> list[Column]:
    weight = F.col(weight_col).cast("double") if weight_col else 1 / F.sqrt(F.greatest(word_count(F.col(text_col)), F.lit(1)))
    usable = weight.isNotNull() & ~F.isnan(weight) & (weight > 0) & (weight < float("inf"))
    step = F.when(usable, F.floor(F.log2(weight) * STEPS)).otherwise(-EXPONENT * STEPS)
    limited = F.greatest(F.lit(-EXPONENT * STEPS), F.least(F.lit(EXPONENT * STEPS), step)).cast("int")
    return [uniform_draw(seed, F.col(id_col), F.col(text_col)).alias("_u"), limited.alias("_class")]


def _with_key(slim: DataFrame, cuts: list[SourceCut]) -> DataFrame:
    """Adds what the class gets, and the Pareto key: ``key / (1 + key)`` in ``KEY_BITS`` bits, null without odds."""
    rows = [{"share_source": c.source, "share_class": k, "source_size": c.size, "target": c.target, "whole": whole, "odds": odds} for c in cuts for k, whole, odds in c.classes]
    # One row a source and class, both of bounded number.
    shares = F.broadcast(slim.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), _SHARES))))
    joined = slim.join(shares, slim["_source"].eqNullSafe(shares["share_source"]) & (slim["_class"] == shares["share_class"]), "left")
    key = F.when(F.col("odds") > 0, (F.col("_u") / (1 - F.col("_u"))) / F.col("odds"))
    return joined.withColumn("_key", F.floor(key / (1 + key) * float(1 << KEY_BITS)).cast("long"))


def _by_source(rows: DataFrame, table: list[dict], schema: str, prefix: str) -> DataFrame:
    """Inner join with one small row a source."""
    small = F.broadcast(rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), schema))))
    return rows.join(small, rows["_source"].eqNullSafe(small[f"{prefix}_source"]))


def _cut_keys(keyed: DataFrame, need: dict[str | None, float]) -> dict[str | None, int]:
    """For each source the largest key that enters, so that the words taken come nearest to what it needs."""
    found: dict[str | None, int] = {}
    opened = {s: (0, n) for s, n in need.items()}  # bucket that holds the cut, words still needed before it
    for shift in range(KEY_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        table = [{"at_source": s, "at_bucket": b, "at_need": n} for s, (b, n) in opened.items()]
        inside = _by_source(keyed, table, "array<struct<at_source:string,at_bucket:long,at_need:double>>", "at")
        inside = inside.where(F.shiftright("_key", shift + BUCKET_BITS) == F.col("at_bucket"))
        counts = inside.groupBy("_source", F.shiftright("_key", shift).alias("bucket")).agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("at_need").alias("need"))
        # 2 ** BUCKET_BITS rows a source at most.
        upto = F.sum("words").over(Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        crossing = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
        rows = crossing.collect()
        # A source without a crossing bucket takes all it has there.
        found |= {s: ((b + 1) << (shift + BUCKET_BITS)) - 1 for s, (b, _) in opened.items() if s not in {r["_source"] for r in rows}}
        opened = {r["_source"]: (r["bucket"], r["need"] - (r["upto"] - r["words"])) for r in rows}
        if not opened or shift == 0 or max(r["n"] for r in rows) <= ORDERED:
            break
    if opened:
        table = [{"at_source": s, "at_bucket": b, "at_need": n} for s, (b, n) in opened.items()]
        inside = _by_source(keyed, table, "array<struct<at_source:string,at_bucket:long,at_need:double>>", "at")
        inside = inside.where(F.shiftright("_key", shift) == F.col("at_bucket")).groupBy("_source", "_key").agg(F.sum("_size").alias("words"), F.first("at_need").alias("need"))
        upto = F.sum("words").over(Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
        taken = inside.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2 <= F.col("need"))
        last = {r["_source"]: r["key"] for r in taken.groupBy("_source").agg(F.max("_key").alias("key")).collect()}
        found |= {s: last.get(s, (b << shift) - 1) for s, (b, _) in opened.items()}
    return found


def plan_mix(slim: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_repeat: float = 3.0) -> list[SourceCut]:
    """The cut of every source, from rows of ``slim_rows``."""
    if slim.select("_source").distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before mixing")
    by_class: dict[str | None, dict[int, int]] = {}
    for r in slim.groupBy("_source", "_class").agg(F.sum("_size").alias("size")).collect():
        by_class.setdefault(r["_source"], {})[r["_class"]] = int(r["size"])
    sizes = {s: sum(c.values()) for s, c in by_class.items()}
    targets = source_targets(sizes, weights, share, max_repeat)
    cuts, need = [], {}
    for source, classes in by_class.items():
        c = factor(classes, targets[source], max_repeat)
        given, left = [], targets[source]
        for k, words in sorted(classes.items()):
            wanted = min(max_repeat, c * 2 ** (k / STEPS))
            whole = int(wanted + 1e-9)
            p = max(0.0, wanted - whole) if wanted - whole > 1e-9 else 0.0
            left -= whole * words
            given.append((k, whole, p / (1 - p)))
        cuts.append(SourceCut(source, sizes[source], targets[source], tuple(given)))
        if any(odds > 0 for _, _, odds in given) and left > 0:
            need[source] = left
    if not need:
        return cuts
    keys = _cut_keys(_with_key(slim, cuts).where(F.col("_key").isNotNull()), need)
    return [replace(c, key=keys.get(c.source, -1)) for c in cuts]


def apply_mix(slim: DataFrame, cuts: list[SourceCut]) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` to rows of ``slim_rows``."""
    keyed = _with_key(slim, cuts)
    limits = F.broadcast(slim.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"cut_source": c.source, "cut_key": c.key} for c in cuts])), _CUTS))))
    keyed = keyed.join(limits, keyed["_source"].eqNullSafe(limits["cut_source"]), "left")
    copies = F.col("whole") + F.when(F.col("_key") <= F.col("cut_key"), 1).otherwise(0)
    return keyed.withColumn("copies", copies.cast("long")).withColumn("taken", (copies * F.col("_size")).cast("long"))


def expand(docs: DataFrame, cuts: list[SourceCut], *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, weight_col: str | None = None) -> DataFrame:
    """The mixed corpus: each row of ``docs``, with all its columns, as often as the mix takes it.

    Documents without words weigh nothing: they are kept once, whatever their share.
    """
    size = word_count(F.col(text_col))
    slim = docs.select(F.struct("*").alias("_row"), F.col(source_col).cast("string").alias("_source"), size.alias("_size"), *_drawn(docs, id_col, text_col, seed, weight_col))
    mixed = apply_mix(slim, cuts)
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("copies")).cast("int")
    return mixed.select("_row", times.alias("_times")).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_n")).select("_row.*")
