"""Benchmark decontamination: BM25 over test items with block-max WAND.

The inverted index holds the test items.  Impacts are divided by what an item
must reach (``reach`` of the score it gives itself), so that one threshold, 1,
holds for every item.  Items lie in blocks; a term knows its largest impact in
each block that has it, and nothing of the other blocks.  A text is cut into
passages of twice the longest item of a *class* of lengths, overlapping by half,
so every occurrence of an item lies whole inside one passage of its class, and a
long item widens the passages of no short one.

The commonest terms of a passage, whose largest impacts together stay below
``REST``, cannot bring an item to 1 alone: blocks of the other terms are summed,
and those that stay below 1 with ``REST`` added are passed over.  In the blocks
left, if the summed maxima of all terms reach 1, cursors move over the postings, skipping to the
pivot whose summed maxima reach 1, and every item above is retrieved.

Retrieved items are verified: a share of the question's five-word shingles and
of the answer's words must stand in the passage.  The last sentence of an item
is its answer; an item of one sentence gives its last third.

The index travels to executors only up to ``part_words`` words of items; a larger
benchmark, in order of ids, is searched in so many parts, one after the other:
each part's hits are written before the next part is sent, and only one is in
memory.  Number of items, document frequencies, mean length and classes are those
of the whole benchmark in every part, so the size of parts changes no hit.

Defined results
---------------
* null or empty texts and items match nothing; words are runs of letters, digits and underscores, lower-cased;
* items with fewer than five question words: the question is one shingle;
* equal items are all reported; null item ids are ignored; repeated rows give
  equal rows; an empty benchmark or corpus gives no hits; other columns of the
  corpus pass through ``find_leaks`` untouched, and a column named as the result
  is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import stage, unstage

#: Marks outside ASCII end a word as those of ASCII do.
MARKS = re.compile(r"[^\w\x00-\x7f]")
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SHINGLE = 5
K1, B = 1.2, 0.75
#: Items whose postings share a block maximum.
BLOCK = 4
#: A class of lengths holds items of up to so many times the words of the class before.
WIDEN = 4
#: Words of texts that are searched together; a longer text alone.
WORDS = 50_000
#: Entries of (passage, block) sums in memory at once.
ENTRIES = 1 << 20
#: What the terms whose blocks are not summed may add to any item.
REST = 0.25
#: A bound may be lower than an exact sum by rounding.
SLACK = 1e-5
HITS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,start:int,end:int>>"
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of word characters, in UTF-8."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Five-word shingles; fewer words are one shingle."""
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [w for w in (words_of(s) for s in SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def length_class(words: int) -> int:
    """The class of an item: the power of ``WIDEN`` that its length does not exceed."""
    return next(c for c in range(64) if words <= WIDEN**c)


@dataclass
class Statistics:
    """What BM25 needs to know of all items that have words; ``longest`` by class."""

    items: int = 0
    words: int = 0
    longest: dict[int, int] = field(default_factory=dict)
    df: Counter = field(default_factory=Counter)


def statistics(texts: Iterable[str]) -> Statistics:
    out = Statistics()
    for text in texts:
        words = words_of(text)
        if words:
            out.items += 1
            out.words += len(words)
            c = length_class(len(words))
            out.longest[c] = max(out.longest.get(c, 0), len(words))
            out.df.update(set(words))
    return out


class ClassIndex:
    """Inverted index of the items of one class of lengths: postings by term, and block maxima by term."""

    def __init__(self, stride: int, items: list[tuple[int, str]], postings: dict[int, list[tuple[int, float]]], terms: int) -> None:
        """``postings`` holds ``(item, impact)`` in order of items, by term; ``terms`` is the number of all terms."""
        self.stride, self.items = stride, items
        self.blocks = -(-len(items) // BLOCK)
        sizes = np.zeros(terms + 1, np.int64)
        for t, posting in postings.items():
            sizes[t + 1] = len(posting)
        self.starts = sizes.cumsum()  # of a term's postings
        self.item, self.impact = np.empty(self.starts[-1], np.int64), np.empty(self.starts[-1])
        for t, posting in postings.items():
            a, b = self.starts[t], self.starts[t + 1]
            self.item[a:b], self.impact[a:b] = zip(*posting, strict=True)
        owner = np.repeat(np.arange(terms), np.diff(self.starts))
        key = owner * self.blocks + self.item // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block_key = key[first]  # term and block, in order
        self.block_from = np.r_[first, len(key)]
        self.block_peak = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.peak_starts = np.searchsorted(self.block_key, np.arange(terms + 1) * self.blocks)
        self.peak = np.zeros(terms)  # of a term, over all blocks
        np.maximum.at(self.peak, owner, self.impact)
        self._verifying: dict[int, tuple[set, Counter]] = {}

    def question_and_answer(self, n: int) -> tuple[set, Counter]:
        """Question shingles and answer words of an item, kept once computed."""
        held = self._verifying.get(n)
        if held is None:
            question, answer = question_and_answer(self.items[n][1])
            held = self._verifying[n] = shingles(question), Counter(answer)
        return held

    def candidate_blocks(self, passage: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
        """Passages (by number) and blocks whose summed maxima reach 1, of pairs ordered by passage."""
        keep = self.peak[terms] > 0
        passage, terms = passage[keep], terms[keep]
        order = np.lexsort((self.peak[terms], passage))
        passage, terms = passage[order], terms[order]
        if not len(terms):
            return
        upto = np.cumsum(self.peak[terms])
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(passage)]))
        upto -= np.r_[0.0, upto[first[1:] - 1]][run]
        essential = upto >= REST
        rest = np.zeros(len(first))
        np.maximum.at(rest, run[~essential], upto[~essential])
        run, term = run[essential], terms[essential]
        n = self.peak_starts[term + 1] - self.peak_starts[term]
        cuts = np.searchsorted(n.cumsum(), np.arange(0, n.sum(), ENTRIES))
        # Chunks end where a passage ends.
        cuts = np.unique(np.r_[np.searchsorted(run, run[cuts]) if len(cuts) else [], len(run)]).astype(np.int64)
        for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
            if a == b:
                continue
            m = n[a:b]
            at = np.repeat(self.peak_starts[term[a:b]] - np.r_[0, m.cumsum()[:-1]], m) + np.arange(m.sum())
            key = np.repeat(run[a:b], m) * self.blocks + self.block_key[at] % self.blocks
            cells, inverse = np.unique(key, return_inverse=True)
            sums = np.bincount(inverse, self.block_peak[at], len(cells))
            for cell in cells[sums + rest[cells // self.blocks] >= 1 - SLACK].tolist():
                yield int(passage[first[cell // self.blocks]]), cell % self.blocks

    def cursors(self, terms: np.ndarray, block: int) -> list[list]:
        """For each term of the block: current item, place, end of its postings there, largest impact."""
        key = terms * self.blocks + block
        at = np.searchsorted(self.block_key, key)
        at = at[(at < len(self.block_key)) & (self.block_key[np.minimum(at, len(self.block_key) - 1)] == key)]
        if self.block_peak[at].sum() < 1 - SLACK:
            return []
        return [[int(self.item[a]), int(a), int(b), float(p)] for a, b, p in zip(self.block_from[at], self.block_from[at + 1], self.block_peak[at], strict=True)]


@dataclass
class ItemIndex:
    """Indexes of one part of the benchmark by class of lengths, over one numbering of terms."""

    terms: dict[bytes, int] = field(default_factory=dict)
    classes: list[ClassIndex] = field(default_factory=list)


def build_index(rows: list[tuple[int, str]], reach: float = 0.5, whole: Statistics | None = None) -> ItemIndex:
    """Index of ``(item_id, text)``, a part of the ``whole`` benchmark or all of it; impacts are relative to ``reach`` of an item's own score."""
    index = ItemIndex()
    bags = [(i, t, Counter(words_of(t))) for i, t in sorted(rows)]
    bags = [(i, t, c) for i, t, c in bags if c]
    if not bags:
        return index
    whole = whole or statistics(t for _, t, _ in bags)
    mean = whole.words / whole.items
    items: dict[int, list[tuple[int, str]]] = {}
    postings: dict[int, dict[int, list[tuple[int, float]]]] = {}
    for item, text, bag in bags:
        size = sum(bag.values())
        impact = {w: math.log1p((whole.items - whole.df[w] + 0.5) / (whole.df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for w, f in bag.items()}
        own = sum(impact.values()) * reach
        c = length_class(size)
        members = items.setdefault(c, [])
        for w, x in impact.items():
            postings.setdefault(c, {}).setdefault(index.terms.setdefault(w, len(index.terms)), []).append((len(members), x / own))
        members.append((item, text))
    index.classes = [ClassIndex(whole.longest[c], items[c], postings[c], len(index.terms)) for c in sorted(items)]
    return index


def block_max_wand(index: ClassIndex, terms: np.ndarray, block: int) -> Iterator[tuple[int, float]]:
    """Items of one block that score 1 or more for a set of terms."""
    cursors = index.cursors(terms, block)
    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, None
        for n, _, _, peak in cursors:
            bound += peak
            if bound >= 1 - SLACK:
                pivot = n
                break
        if pivot is None:
            return
        behind = [c for c in cursors if c[0] <= pivot]
        target = pivot
        if behind[0][0] == pivot:
            score = float(sum(index.impact[c[1]] for c in behind))
            if score >= 1:
                yield pivot, score
            target = pivot + 1
        for c in behind:
            while c[1] < c[2] and index.item[c[1]] < target:
                c[1] += 1
            c[0] = int(index.item[c[1]]) if c[1] < c[2] else -1
        cursors = [c for c in cursors if c[0] >= 0]


def _leaks_of_class(index: ClassIndex, texts: list[list[bytes]], owner: np.ndarray, at: np.ndarray, ids: np.ndarray, size: int, min_question: float, min_answer: float) -> Iterator[tuple[int, dict]]:
    """Verified items of a class, each once a text, with its best passage; ``ids`` are known words, ``at`` their places in their ``owner``."""
    # Passage p of a text holds the words from p * stride on, twice stride of them; passages of all texts are numbered on.
    stride = index.stride
    last = np.array([max(0, -(-len(words) // stride) - 2) for words in texts])
    base = np.r_[0, (last + 1).cumsum()]
    own = at // stride
    pairs = np.concatenate([base[owner] + np.minimum(own, last[owner]), base[owner] + np.maximum(own - 1, 0)]) * size + np.tile(ids, 2)
    pairs.sort()
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    passage, terms = pairs // size, pairs % size
    best: dict[tuple[int, int], dict] = {}
    for p, block in index.candidate_blocks(passage, terms):
        text = int(np.searchsorted(base, p, "right")) - 1
        words, first = texts[text], p - int(base[text])
        a, b = first * stride, min((first + 2) * stride, len(words))
        for n, score in block_max_wand(index, terms[np.searchsorted(passage, p) : np.searchsorted(passage, p, "right")], block):
            if score <= best.get((text, n), {"score": 0})["score"]:
                continue
            question, answer = index.question_and_answer(n)
            here = {tuple(words[i : i + k]) for k in {len(s) for s in question} for i in range(a, b - k + 1)}
            q = len(question & here) / len(question) if question else 1.0
            r = sum((answer & Counter(words[a:b])).values()) / sum(answer.values()) if answer else 1.0
            if q >= min_question and r >= min_answer:
                best[text, n] = {"item_id": index.items[n][0], "score": score, "question_overlap": q, "answer_overlap": r, "start": a, "end": b}
    yield from ((text, hit) for (text, _), hit in best.items())


def leaks_of(index: ItemIndex, texts: Iterable[str | None], min_question: float, min_answer: float) -> Iterator[list[dict]]:
    """For each whole text its verified items, each once; texts are searched together up to ``WORDS`` words."""
    get = index.terms.get
    group: list[list[bytes]] = []

    def searched() -> Iterator[list[dict]]:
        ids = [np.fromiter((get(w, -1) for w in words), np.int64, len(words)) for words in group]
        places = [np.flatnonzero(i >= 0) for i in ids]
        owner = np.repeat(np.arange(len(group)), [len(p) for p in places])
        found: list[list[dict]] = [[] for _ in group]
        if len(owner):
            at, known = np.concatenate(places), np.concatenate([i[p] for i, p in zip(ids, places, strict=True)])
            for c in index.classes:
                for text, hit in _leaks_of_class(c, group, owner, at, known, len(index.terms), min_question, min_answer):
                    found[text].append(hit)
        group.clear()
        return (sorted(hits, key=lambda hit: hit["item_id"]) for hits in found)

    size = 0
    for text in texts:
        group.append(words_of(text) if index.terms else [])
        size += len(group[-1]) + 1
        if size >= WORDS:
            yield from searched()
            size = 0
    yield from searched()


def _parts(rows: DataFrame, part_words: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of ``part_words`` words, or of one longer item, by id; only one is in memory."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r["text"]))
        if part and size + n > part_words:
            yield part
            part, size = [], 0
        part.append((int(r["item_id"]), r["text"]))
        size += n
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", out: str = "leaks", reach: float = 0.5, min_question: float = 0.5, min_answer: float = 0.5, part_words: int = 2_000_000) -> DataFrame:
    """``docs`` with a column ``out``: the verified benchmark items of each text."""
    if out in docs.columns:
        raise ValueError(f"the input has a column {out!r} of its own")
    spark = docs.sparkSession
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    whole = statistics(r["text"] for r in rows.toLocalIterator())
    found, shared, written = docs.withColumn(out, F.array().cast(HITS)), None, None
    for part in _parts(rows, part_words):
        if shared is not None:
            before, written = written, stage(found, "leaks")
            shared.unpersist()
            if before is not None:
                unstage(before)
            found = written
        shared = spark.sparkContext.broadcast(build_index(part, reach, whole))
        hits = _search(shared, min_question, min_answer)(F.col(text_col))
        found = found.withColumn(out, hits if written is None else F.concat(out, hits))
    return found


def _search(shared, min_question: float, min_answer: float):
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(leaks_of(shared.value, (t.as_py() for t in batch), min_question, min_answer), _ARROW_HITS)

    search.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(search, HITS)
