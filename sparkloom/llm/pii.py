"""Personal data: fixed formats, and contextual patterns bootstrapped from them.

Fixed formats (``email``, ``ip``, ``card``, ``phone``) are reported as they
stand and are the seeds of the bootstrap.  A *cue* is the word before an
identifier, or what stands before it in its own word (``tel:+49...``); an
*instance* is an identifier, known or merely looking like one (a token with
digits).  Spark scores the graph of cues and instances in rounds:

* a cue is worth the confidence of its instances, each as often as it stands
  behind the cue, divided by how often the cue stands in the whole corpus, so
  that common words score near 0 and copies change nothing;
* an instance is worth ``1 - product(1 - worth)`` over its cues; seeds stay 1.

Cues with enough distinct seeds and worth induce patterns; what looks like an
identifier behind such a cue is reported as ``context`` unless a fixed format
covers part of it.  Only DataFrame functions are used, and no graph reaches the
driver.

Defined results
---------------
* null text counts as empty: no spans, the digest is that of the empty string;
* repeated rows count once for each row in corpus statistics, above and below the
  line; their values are one instance, and one seed, however often they stand; ids may be null or repeated, rows are told apart by a row
  number given when the scan is written;
* extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.spans import apart, locate, matches, tagged
from sparkloom.storage import stage

KINDS = ("email", "ip", "card", "phone", "context")

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9])++"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Token that looks like an identifier: six characters or more, one a digit.
LOOKS = r"(?<![A-Za-z0-9._@+/-])(?=[A-Za-z._@+/-]*+[0-9])[A-Za-z0-9._@+/-]{6,}+"
#: What a text must hold for a pattern to match anywhere in it: a quick look that spares most texts the search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "looks": "[0-9]"}
#: Last characters of cues that are told apart when their attached places are sought; more are all sought.
ENDINGS = 256
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        # Leading zeros make an octet's alternatives ambiguous, so the match is anchored on both sides.
        return span["match"].rlike(rf"^(?:{_OCTET.replace('*+', '*')})(?:\.(?:{_OCTET.replace('*+', '*')})){{3}}$")
    n = F.length(_digits(span["match"]))
    if kind == "card":
        return F.when(n.between(12, 19), passes_luhn(_digits(span["match"]))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _validator(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span)


def cue_of(left: Column) -> Column:
    """The word before a match, lower-cased, without digits; null if there is none."""
    word = F.lower(F.regexp_extract(left, r"(?<!\S)(\S++)[\x20\x09-\x0D]*+$", 1))
    return F.nullif(F.regexp_replace(word, "[0-9]", ""), F.lit(""))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written rows ``row, doc_id, base, found``: tags of fixed formats, and all instances with cues."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_ = PATTERNS | {"looks": LOOKS}
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", "text", *[F.when(F.col("text").rlike(NEEDS[k]), matches(F.col("text"), p)).otherwise(none).alias(f"m_{k}") for k, p in all_.items()])
    rows = rows.select("doc_id", locate(F.col("text"), [*all_.values()], [F.col(f"m_{k}") for k in all_], cue_of).alias("spans"))
    span = lambda k: F.element_at("spans", [*all_].index(k) + 1)
    rows = rows.select("doc_id", *[F.filter(span(k), _validator(k)).alias(k) for k in PATTERNS], span("looks").alias("looks"))
    base = F.concat(*[tagged(F.col(k), i) for i, k in enumerate(PATTERNS)])
    rows = rows.select("doc_id", base.alias("base"), *all_)
    # Digits that begin an address are no instance beside it: a cue has one instance behind it.
    rest = F.transform(F.concat("ip", "card", "phone"), lambda s: F.struct(s["start"].alias("start"), (s["start"] + 1).alias("end"), s.alias("whole")))
    points = F.transform("email", lambda s: F.struct(s["start"].alias("start"), (s["start"] + 1).alias("end")))
    seeds = F.concat("email", F.transform(apart(rest, points), lambda x: x["whole"]))
    rows = rows.select("doc_id", "base", seeds.alias("seeds"), apart(F.col("looks"), F.col("base")).alias("looks"))
    as_instance = lambda s, seed: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("value"), s["left"].alias("cue"), F.lit(seed).alias("seed"))
    found = F.concat(F.transform("seeds", lambda s: as_instance(s, True)), F.transform("looks", lambda s: as_instance(s, False)))
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", found.alias("found")), "pii-scan")


def _bare(text: Column) -> Column:
    return F.translate(text, "0123456789", "")


def attached_cues(word: Column, endings: str, longest: int) -> Column:
    """The parts of a lower-cased word up to every place where an identifier can start, without digits.

    Such a place follows a character of ``endings`` that is neither letter nor
    digit, or lies between a letter and a digit or plus sign.  Every piece but the
    last has a character that is no digit, so ``longest`` pieces make the longest cue.
    """
    empty = F.array().cast("array<string>")

    def step(acc: Column, piece: Column) -> Column:
        part = F.concat(acc["part"], _bare(piece))
        longer = F.struct(part.alias("part"), F.concat(acc["out"], F.array(part)).alias("out"))
        return F.when(F.length(acc["part"]) < longest, longer).otherwise(acc)

    places = f"(?<={endings})(?!$)|(?<=[a-z])(?=[0-9+])"
    pieces = F.split(word, places, longest + 1)
    # The last piece ends the word, unless there are too many.
    before = F.slice(pieces, 1, F.least(F.lit(longest), F.size(pieces) - 1))
    return F.array_distinct(F.aggregate(before, F.struct(F.lit("").alias("part"), empty.alias("out")), step, lambda acc: acc["out"]))


def _endings(cues: DataFrame) -> str:
    """A character class of all that cues end with, letters and digits aside; any such character if they are many."""
    last = F.substring("cue", -1, 1)
    found = [r[0] for r in cues.select(last).where(~last.rlike("[a-z0-9]")).distinct().limit(ENDINGS + 1).collect()]
    if len(found) > ENDINGS:
        return "[^a-z0-9]"
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(found)) + "]" if found else "[^\\x{0}-\\x{10ffff}]"


def cue_counts(docs: DataFrame, cues: DataFrame, text_col: str = "text", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """In how many words of all texts each of ``cues`` stands, alone or attached: ``cue, occurrences``.

    Words that are no cue are left out before the shuffle while the cues fit in
    ``broadcast_bytes``; more cues meet the counts of all words after it.  Few
    words have a place where a cue could be attached, and only those are cut up.
    """
    size, longest = cues.agg(F.sum(F.octet_length("cue") + 32), F.max(F.length("cue"))).first()
    if not size:
        return cues.select("cue", F.lit(0).cast("long").alias("occurrences")).limit(0)
    endings = _endings(cues)
    small = size <= broadcast_bytes
    known = lambda words: words.join(F.broadcast(cues.select("cue")), "cue", "left_semi") if small else words
    space = r"[\x20\x09-\x0D]++"
    lower = F.lower(F.col(text_col))
    alone = docs.select(F.explode(F.split(_bare(lower), space)).alias("cue"))
    within = docs.select(F.explode(F.split(lower, space)).alias("word")).where(F.col("word").rlike(f"{endings}.|[a-z][0-9+]"))
    attached = F.array_except(attached_cues(F.col("word"), endings, longest), F.array(_bare(F.col("word"))))
    words = known(alone).union(known(within.select(F.explode(attached).alias("cue"))))
    counts = words.groupBy("cue").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts if small else counts.join(cues.select("cue"), "cue", "left_semi")


def bootstrap(scanned: DataFrame, docs: DataFrame, *, text_col: str = "text", rounds: int = 3, min_worth: float = 0.6, min_seeds: int = 5) -> DataFrame:
    """Cues that induce a pattern: ``cue, worth, seeds``."""
    edges = scanned.select(F.explode("found").alias("f")).select("f.cue", "f.value", "f.seed").where(F.col("cue").isNotNull())
    edges = stage(edges.groupBy("cue", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "pii-edges")
    seeded = stage(edges.groupBy("cue").agg(F.count_if("seed").alias("seeds"), F.sum("n").alias("behind")).where(F.col("seeds") >= min_seeds), "pii-seeded")
    # A cue between two identifiers of one word is the start of no word: it stands at least as often as its instances.
    stands = F.greatest(F.coalesce("occurrences", F.lit(0)), F.col("behind")).alias("occurrences")
    counts = stage(seeded.join(cue_counts(docs, seeded.select("cue"), text_col), "cue", "left").select("cue", "seeds", stands), "pii-cues")
    graph = edges.join(counts, "cue")
    belief = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    worth = None
    for i in range(rounds):
        total = graph.join(belief, "value").groupBy("cue").agg(F.sum(F.col("n") * F.col("belief")).alias("support"), F.first("occurrences").alias("occurrences"), F.first("seeds").alias("seeds"))
        worth = stage(total.select("cue", "seeds", F.least(F.lit(0.999), F.col("support") / (F.col("occurrences") + 1)).alias("worth")), f"pii-round-{i}")
        doubt = F.exp(F.sum(F.log1p(-F.coalesce("worth", F.lit(0.0)))))
        belief = edges.join(worth.select("cue", "worth"), "cue", "left").groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("belief"))
    return worth.where(F.col("worth") >= min_worth)


def find_personal(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_worth: float = 0.6, min_seeds: int = 5) -> DataFrame:
    """``doc_id, base, added``: arrays of ``struct<start, kind, end>``; ``kind`` indexes ``KINDS``."""
    scanned = scan(docs, id_col=id_col, text_col=text_col)
    cues = bootstrap(scanned, docs, text_col=text_col, rounds=rounds, min_worth=min_worth, min_seeds=min_seeds)
    unseen = scanned.select("row", F.explode("found").alias("f")).where(~F.col("f.seed")).select("row", "f.start", "f.end", "f.cue")
    added = unseen.join(cues.select("cue"), "cue", "left_semi")
    tags = added.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.join(tags, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))
