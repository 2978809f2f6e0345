"""Repeated byte strings, found with a distributed merge sort of suffixes.

Bytes covered by a string of ``width`` bytes that starts anywhere else, too, are
removed.  Sorting every suffix of a corpus is not needed for that: each window of
``width`` bytes has a *window anchor*, the position of its least ``GRAM``-byte
hash, and equal windows have their anchors at equal offsets.  So only suffixes at
anchors are sorted, each with the bytes to its left.

1. *Census.*  Anchors whose gram is unique are dropped: no window around them can
   stand twice.  Grams that hold a fixed share of all anchors are few; they are
   broadcast, so that no gram's anchors meet in one task.
2. *Sorted runs.*  A task sorts the suffixes at its anchors.  Equal ones (same
   bytes left and right) are merged at once, and their windows are known to
   repeat.  The run is front-coded: each suffix stores how many bytes it shares
   with the one before it, and the rest.  Runs are cut at splitters and exchanged.
3. *Merge.*  A loser tree combines the runs of a range.  It keeps for every loser
   the number of bytes shared with the last winner; a longer shared prefix decides
   without looking at bytes, and equal ones are compared from that byte on, so
   known prefixes are never compared again.  It yields the order and its common
   prefixes.
4. *Verdicts.*  A window at offset ``d`` before an anchor repeats if another
   suffix shares ``width - d`` bytes to the right and ``d`` to the left.  Ranks of
   right and left contexts under these common prefixes decide it for all at once.

Defined results
---------------
* null text counts as empty; texts shorter than ``width`` lose nothing;
* repeated rows and equal texts repeat each other and lose all that is long
  enough; null and repeated ids are rows of their own;
* overlaps count, within a document, too; an empty table gives an empty result;
* extra columns are not read;
* rows are told apart by 128 bits of hashes of id and text, ``row_key`` and
  ``row_check``: among 10**12 rows a collision has a chance of about 10**-15.
"""

from __future__ import annotations

import hashlib
import math
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.hashing import _BASE, _INVERSE, PIECE, mix, powers
from sparkloom.storage import stage, unstage

WIDTH = 200
GRAM = 64
#: Suffixes of a sorted run; a task with more writes several.
RUN = 60_000
#: Suffixes that one range should hold.
RANGE = 100_000
#: Bytes that splitters look at: less than a gram, so that a gram's suffixes stay together.
SPLIT = 16
_HEAD = struct.Struct("<HHHBqqi")  # shared, rest, right length, repeated, row key and check, position
Row = tuple[int, int]
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, best: np.ufunc, worst: np.uint64) -> np.ndarray:
    """Least or largest value of every ``width`` values in a row."""
    n = len(values)
    rows = np.concatenate([values, np.full(-n % width, worst, np.uint64)]).reshape(-1, width)
    before = best.accumulate(rows, axis=1).ravel()
    after = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def _anchors(parts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    buffer = b"".join(parts)
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    span, n = width - GRAM + 1, len(buffer) - GRAM + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < span:
        yield from (none for _ in parts)
        return
    data = np.frombuffer(buffer, np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(_INVERSE, n))
    end = np.repeat(ends, lengths)
    at = np.arange(n)
    whole = at + GRAM <= end[:n]
    h[~whole] = _LAST
    least = _sliding(h, span, np.minimum, _LAST)
    least[at[: len(least)] + width > end[: len(least)]] = 0
    pad = np.zeros(span - 1, np.uint64)
    top = _sliding(np.concatenate([pad, least, pad]), span, np.maximum, np.uint64(0))
    chosen = np.flatnonzero((top == h) & whole & (top > 0))
    upto = np.searchsorted(chosen, np.r_[0, ends])
    for a, b, start in zip(upto[:-1], upto[1:], ends - lengths, strict=True):
        yield chosen[a:b] - start, h[chosen[a:b]]


def anchors_of(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and gram hashes of the anchors of each text, however long."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) > PIECE:
            if group:
                yield from _anchors(group, width)
                group, size = [], 0
            found = [(s, next(_anchors([text[s : s + PIECE + width - 1]], width))) for s in range(0, len(text), PIECE)]
            positions, first = np.unique(np.concatenate([p + s for s, (p, _) in found]), return_index=True)
            yield positions, np.concatenate([h for _, (_, h) in found])[first]
            continue
        group.append(text)
        size += len(text)
        if size >= PIECE:
            yield from _anchors(group, width)
            group, size = [], 0
    if group:
        yield from _anchors(group, width)


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _emit_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys = batch["row_key"].to_numpy(zero_copy_only=False)
            found = [*anchors_of(_encoded(batch["text"]), width)]
            counts = [len(p) for p, _ in found]
            if sum(counts):
                positions, grams = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, counts)), pa.array(positions.astype(np.int32)), pa.array(grams.view(np.int64))], names=["row_key", "pos", "gram"])

    return run


def _emit_prefixes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = _encoded(batch["text"])
            out = [t[p : p + SPLIT] for t, (positions, _) in zip(texts, anchors_of(texts, width), strict=True) for p in positions[:: max(1, len(positions) // 8)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["prefix"])

    return run


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that ``a`` and ``b`` share, known to agree before ``start``."""
    low, high = start, min(len(a), len(b))
    step = 16
    while low < high:
        end = min(low + step, high)
        if a[low:end] == b[low:end]:
            low, step = end, step * 2
        elif step == 1 or end - low == 1:
            return low
        else:
            high, step = end, max(1, (end - low) // 2)
    return low


def front_code(run: list[tuple[bytes, int, bool, Row, int]]) -> bytes:
    """A sorted run of ``(key, right length, repeated, row, position)`` as bytes."""
    out, last = [], b""
    for key, right, repeated, row, pos in run:
        shared = common_prefix(last, key)
        out += [_HEAD.pack(shared, len(key) - shared, right, repeated, *row, pos), key[shared:]]
        last = key
    return b"".join(out)


def decode(payload: bytes) -> Iterator[tuple[int, bytes, int, bool, Row, int]]:
    """``(shared with the key before, key, right length, repeated, row, position)`` of a run."""
    at, last, size = 0, b"", _HEAD.size
    while at < len(payload):
        shared, rest, right, repeated, row, check, pos = _HEAD.unpack_from(payload, at)
        at += size
        last = last[:shared] + payload[at : at + rest]
        at += rest
        yield shared, last, right, bool(repeated), (row, check), pos


class LoserTree:
    """Merges front-coded runs; yields each entry with the bytes it shares with the one before it."""

    def __init__(self, payloads: list[bytes]) -> None:
        self.runs = [decode(p) for p in payloads]
        self.heads = [next(r, None) for r in self.runs]
        self.shared = [0] * len(self.runs)  # with the last winner
        self.size = 1
        while self.size < max(1, len(self.runs)):
            self.size *= 2
        self.heads += [None] * (self.size - len(self.heads))
        self.shared += [0] * (self.size - len(self.shared))
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes the one with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        i, j = self.shared[a], self.shared[b]
        if i != j:
            return (a, b) if i > j else (b, a)
        common = common_prefix(x[1], y[1], i)
        first = x[1][common:] <= y[1][common:] if common < len(x[1]) and common < len(y[1]) else len(x[1]) <= len(y[1])
        won, lost = (a, b) if first else (b, a)
        self.shared[lost] = common
        return won, lost

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return won

    def __iter__(self) -> Iterator[tuple[int, tuple[int, bytes, int, bool, Row, int]]]:
        while self.heads[self.winner] is not None:
            leaf = self.winner
            yield self.shared[leaf], self.heads[leaf]
            self.heads[leaf] = following = next(self.runs[leaf], None)
            self.shared[leaf] = following[0] if following else 0  # a run's own shared length is that with the winner
            node, won = (leaf + self.size) // 2, leaf
            while node:
                won, self.losers[node] = self._play(won, self.losers[node])
                node //= 2
            self.winner = won


def _key(text: bytes, pos: int, width: int) -> tuple[bytes, int]:
    """Bytes from an anchor on, padded to ``width``, and then those before it; the length without padding."""
    right = text[pos : pos + width]
    return right.ljust(width, b"\0") + text[max(0, pos - (width - GRAM)) : pos][::-1], len(right)


RUN_SCHEMA = "dest int, payload binary, row_key long, row_check long, start int, end int"
SPAN_SCHEMA = "row_key long, row_check long, start int, end int"


def _emit_runs(splitters: list[bytes], width: int):
    """Front-coded runs by range, and the spans of suffixes that are equal within a run.

    Those spans ride along to some range, spread evenly, so that one exchange carries all.
    """
    types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]

    def span(key: bytes, right: int, row: Row, pos: int) -> tuple:
        return row[0] % (len(splitters) + 1), None, *row, pos - (len(key) - width), pos + right

    def sealed(entries: list[tuple[bytes, int, Row, int]]) -> pa.RecordBatch:
        entries.sort()
        run, rows, cuts = [], [], []
        at = 0
        while at < len(entries):
            end = at + 1
            while end < len(entries) and entries[end][:2] == entries[at][:2]:
                end += 1
            key, right, row, pos = entries[at]
            if end - at > 1 and right + len(key) - width >= width:
                rows += [span(*e) for e in entries[at:end]]
            dest = bisect_right(splitters, key[:SPLIT])
            if not cuts or cuts[-1][0] != dest:
                cuts.append((dest, len(run)))
            run.append((key, right, end - at > 1, row, pos))
            at = end
        ends = [c for _, c in cuts[1:]] + [len(run)]
        rows += [(d, front_code(run[a:b]), None, None, None, None) for (d, a), b in zip(cuts, ends, strict=True)]
        entries.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple[bytes, int, Row, int]] = []
        for batch in _slices(batches):
            keys = zip(batch["row_key"].to_pylist(), batch["row_check"].to_pylist(), strict=True)
            for text, row, positions in zip(_encoded(batch["text"]), keys, batch["positions"].to_pylist(), strict=True):
                for pos in positions:
                    entries.append((*_key(text, pos, width), row, pos))
                    if len(entries) >= RUN:
                        yield sealed(entries)
        if entries:
            yield sealed(entries)

    return run


def repeated_offsets(group: list[tuple[bytes, int, bool]], shared: list[int], width: int) -> list[tuple[int, int] | None]:
    """For suffixes in order the least and largest offset of a repeated window, if any.

    ``group`` has distinct ``(key, right length, repeated)``; ``shared[i]`` is what
    suffix ``i`` shares on the right with the one before it.
    """
    n, out = len(group), [None] * len(group)
    lefts = [k[width:] for k, _, _ in group]

    def note(i: int, low: int, high: int) -> None:
        if low <= high:
            old = out[i]
            out[i] = (low, high) if old is None else (min(old[0], low), max(old[1], high))

    for i, (_, right, repeated) in enumerate(group):
        if repeated:
            note(i, max(0, width - right), len(lefts[i]))
    if n <= 32:
        for i in range(n):
            right = width
            for j in range(i + 1, n):
                right = min(right, shared[j])
                if right < GRAM:
                    break
                low, high = max(0, width - right), common_prefix(lefts[i], lefts[j])
                note(i, low, high)
                note(j, low, high)
        return out
    order = np.array(sorted(range(n), key=lefts.__getitem__))
    left_shared = np.array([0, *(common_prefix(lefts[a], lefts[b]) for a, b in zip(order[:-1], order[1:], strict=True))])
    right_shared = np.array(shared)
    lengths = np.array([len(x) for x in lefts])
    rank = np.empty(n, np.int64)
    for d in range(width - GRAM + 1):
        rank[order] = np.cumsum(left_shared < d)
        pair = np.cumsum(right_shared < width - d) * (n + 1) + rank
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        for i in np.flatnonzero((counts[inverse] > 1) & (lengths >= d)).tolist():
            note(i, d, d)
    return out


def _merge(width: int):
    names = [c.split()[0] for c in SPAN_SCHEMA.split(", ")]

    def verdicts(payloads: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        group: list[tuple[bytes, int, bool]] = []
        shared: list[int] = []
        places: list[list[tuple[Row, int]]] = []

        def decided() -> Iterator[tuple[int, int, int, int]]:
            if len(group) > 1 or (group and group[0][2]):
                for window, at in zip(repeated_offsets(group, shared, width), places, strict=True):
                    if window:
                        yield from ((*row, pos - window[1], pos - window[0] + width) for row, pos in at)
            group.clear(), shared.clear(), places.clear()

        for common, (_, key, right, repeated, row, pos) in LoserTree(payloads):
            common = min(common, right, group[-1][1]) if group else 0
            if group and key == group[-1][0] and right == group[-1][1]:
                group[-1] = (key, right, True)
                places[-1].append((row, pos))
                continue
            if common < GRAM:
                yield from decided()
            group.append((key, right, repeated))
            shared.append(common)
            places.append([(row, pos)])
        yield from decided()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, payloads = None, []

        def result() -> Iterator[pa.RecordBatch]:
            rows = [*verdicts(payloads)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=names)

        for batch in batches:
            spans = batch.filter(batch["payload"].is_null())
            if len(spans):
                yield spans.select(names)
            batch = batch.filter(batch["payload"].is_valid())
            for dest, payload in zip(batch["dest"].to_pylist(), batch["payload"], strict=True):
                if dest != current:
                    yield from result()
                    current, payloads = dest, []
                payloads.append(payload.as_py())
        yield from result()

    return run


def merged_spans(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of spans that touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        rows = []
        for text, spans in zip(_encoded(batch["text"]), batch["spans"].to_pylist(), strict=True):
            runs = merged_spans([s["start"] for s in spans or ()], [s["end"] for s in spans or ()])
            kept = hashlib.sha256()
            at = 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in runs), runs, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                *[pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)],
                pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([r[3] for r in rows], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"],
        )


def repeated_anchors(anchors: DataFrame, share: float = 1e-5) -> DataFrame:
    """Anchors whose gram stands more than once: ``row_key, positions``.

    At most ``1 / share`` grams hold a ``share`` of all anchors; these are
    broadcast, and only the anchors of other grams are joined by a shuffle.
    """
    seen = stage(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-grams")
    bound = max(2, math.ceil(share * anchors.count()))
    hot = F.broadcast(seen.where(F.col("n") >= bound).select("gram"))
    rest = seen.where(F.col("n") < bound).select("gram")
    held = anchors.join(hot, "gram", "left_semi").union(anchors.join(hot, "gram", "left_anti").join(rest, "gram", "left_semi"))
    wanted = stage(held.groupBy("row_key").agg(F.array_sort(F.collect_set("pos")).alias("positions")), "suffix-wanted")
    unstage(seen)
    return wanted


def find_repeats(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, spans, kept_sha256``; spans in bytes, end exclusive."""
    id_, text = F.col(id_col), F.col(text_col)
    rows = docs.select(id_.cast("long").alias("doc_id"), F.xxhash64(id_, text).alias("row_key"), F.xxhash64(F.lit("check"), text, id_).alias("row_check"), text.alias("text"))
    long = rows.where(F.octet_length("text") >= width).select("row_key", "row_check", "text")
    anchors = stage(long.mapInArrow(_emit_anchors(width), "row_key long, pos int, gram long"), "suffix-anchors")
    wanted = repeated_anchors(anchors)
    unstage(anchors)

    size = wanted.agg(F.sum(F.size("positions"))).collect()[0][0] or 0
    total = long.count() if size else 0
    sample = max(sample, -(-4 * size // RANGE))
    draw = F.pmod(F.xxhash64(F.lit("splitters"), "row_key"), F.lit(1 << 30)) / float(1 << 30)
    prefixes = sorted(bytes(r["prefix"]) for r in long.where(draw < sample / max(total, 1)).mapInArrow(_emit_prefixes(width), "prefix binary").limit(16 * sample).collect()) if size > RANGE else []
    ranges = min(len(prefixes), -(-size // RANGE))
    splitters = sorted({prefixes[i * len(prefixes) // ranges] for i in range(1, ranges)}) if ranges else []

    runs = long.join(wanted, "row_key").mapInArrow(_emit_runs(splitters, width), RUN_SCHEMA)
    merged = runs.repartition(len(splitters) + 1, "dest").sortWithinPartitions("dest").mapInArrow(_merge(width), SPAN_SCHEMA)
    spans = stage(merged.groupBy("row_key", "row_check").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")
    unstage(wanted)
    return rows.join(spans, ["row_key", "row_check"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
