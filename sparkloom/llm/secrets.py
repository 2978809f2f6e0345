"""Secret scan: fixed formats, and sliding-window entropy over candidate strings.

Fixed formats (``assign``, ``access``, ``hex``) are reported as they stand.
Beside them every maximal run of token characters is a candidate.  A candidate
has the narrowest character class that holds all its characters; over it slides
a window whose Shannon entropy is kept up to date by the two counts that change
with each step.  If the entropy of any window reaches the bound of the class,
the candidate is reported as ``entropy``, unless the allow-list knows it or a
fixed format covers part of it.  Only SQL functions are used.

Defined results
---------------
* null text counts as empty: no spans, the digest is that of the empty string;
* candidates shorter than the window are never reported as ``entropy``;
* equal rows give equal results, ids may be null or repeated; extra columns are
  not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.spans import apart, bound, locate, matches, tagged

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

# Strings that look random but are no secrets.
ALLOWED = (
    r"[0-9+/_=-]++",  # numbers
    r"[A-Za-z/_=-]++",  # words and paths without a digit
    r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}",  # UUID
    r"(?i).*(?:example|placeholder|changeme|dummy|sample|your[_-]?).*",
    r"(?i).*(?:xxxx|0123456789|abcdefgh|1234567890).*",
    r"(?:[A-Za-z]++[/_=-])++[A-Za-z]*+[0-9]{0,4}",  # names with a short number
)


@dataclass(frozen=True)
class CharacterClass:
    """An alphabet and the share of the window's largest possible entropy that is suspicious."""

    alphabet: str
    share: float


# Character classes from narrow to wide.
CLASSES = (
    CharacterClass("0123456789abcdef", 0.75),
    CharacterClass("0123456789ABCDEF", 0.75),
    CharacterClass("0123456789abcdefghijklmnopqrstuvwxyz", 0.87),
    CharacterClass("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.87),
    CharacterClass("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 0.87),
)


#: Largest window: a count is one printable character of the state.
MOST = 60
_ZERO = 65  # the character of the count 0


def peak_entropy(text: Column, alphabet: str, window: int) -> Column:
    """Largest Shannon entropy in bits of any ``window`` characters of ``text``, all of ``alphabet``.

    The state of the fold is a string with one character a symbol, its count.  A
    step of the window is two changes of one count, of the symbol that leaves
    and of the one that enters; each also changes the sum of ``c * log2(c)``.
    """
    if not 1 <= window <= MOST:
        raise ValueError(f"a window has 1 to {MOST} characters")
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    state = "struct<counts:string,sum:double,seen:int,peak:double>"

    def change(acc: Column, by: Column) -> Column:
        symbol = F.abs(by)
        held = F.ascii(F.substring(acc["counts"], symbol, F.lit(1))) - _ZERO

        def changed(count: Column) -> Column:
            now = count + F.signum(by).cast("int")
            total = acc["sum"] + F.element_at(weight, now + 1) - F.element_at(weight, count + 1)
            seen = acc["seen"] + F.when(by > 0, 1).otherwise(0)
            peak = F.when((by > 0) & (seen >= window), F.greatest(acc["peak"], math.log2(window) - total / window)).otherwise(acc["peak"])
            return F.struct(F.overlay(acc["counts"], F.char(now + _ZERO), symbol, F.lit(1)).alias("counts"), total.alias("sum"), seen.alias("seen"), peak.alias("peak")).cast(state)

        return bound(held, changed)

    def peak(symbols: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), window), F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - window, F.lit(0))))
        changes = F.filter(F.flatten(F.zip_with(leaving, symbols, lambda old, new: F.array(-old, new))), lambda by: by != 0)
        start = F.struct(F.lit(chr(_ZERO) * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("peak")).cast(state)
        return F.aggregate(changes, start, change, lambda acc: acc["peak"])

    symbols = F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), lambda c: F.position(c, F.lit(alphabet)))
    return F.when(F.length(text) < window, 0.0).otherwise(bound(symbols, peak))


def is_random(text: Column, window: int) -> Column:
    """Whether a candidate reaches the entropy bound of its class and is on no allow-list."""
    least = F.lit(math.inf)
    for c in reversed(CLASSES):
        inside = text.rlike("^[" + c.alphabet.replace("-", "\\-") + "]++$")
        least = F.when(inside, c.share * math.log2(min(window, len(c.alphabet)))).otherwise(least)
    allowed = text.rlike("|".join(f"(?:^(?:{p})$)" for p in ALLOWED))
    # Counts do not depend on the class, so the alphabet of the widest serves all.
    return F.when(allowed, False).otherwise(peak_entropy(text, CLASSES[-1].alphabet, window) >= least - 1e-9)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``doc_id, base, added``: arrays of ``struct<start, kind, end>``; ``kind`` indexes ``KINDS``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    rows = rows.select("doc_id", "text", *[matches(F.col("text"), p).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select("doc_id", locate(F.col("text"), [*patterns.values()], [F.col(f"m_{k}") for k in patterns]).alias("spans"))
    rows = rows.select("doc_id", *[F.element_at("spans", i + 1).alias(k) for i, k in enumerate(patterns)])
    value = lambda s: F.regexp_extract(s["match"], ASSIGN, 2)
    base = F.concat(
        tagged(F.filter("assign", lambda s: F.length(value(s)) >= 8), 0),
        tagged(F.col("access"), 1),
        tagged(F.col("hex"), 2),
    )
    rows = rows.select("doc_id", base.alias("base"), "candidate")
    rows = rows.select("doc_id", "base", apart(F.col("candidate"), F.col("base")).alias("free"))
    return rows.select("doc_id", "base", tagged(F.filter("free", lambda s: is_random(s["match"], window)), 3).alias("added"))
