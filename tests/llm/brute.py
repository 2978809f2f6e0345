"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def digest(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return hashlib.sha256(text.encode()).hexdigest()


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def shingle_sets(text: str | None, n: int) -> frozenset[tuple[bytes, ...]]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard_components(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest linked doc_id)."""
    sets = {i: shingle_sets(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    holders: dict[tuple[bytes, ...], list[int]] = {}
    for i in ids:
        seen: dict[int, int] = {}
        for s in sets[i]:
            for j in holders.get(s, ()):
                seen[j] = seen.get(j, 0) + 1
        for j, common in seen.items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_bytes(texts: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """Maximal runs of each text that are covered by strings of ``width`` bytes standing twice or more."""
    counts: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            counts[t[i : i + width]] = counts.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        runs: list[list[int]] = []
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + width
                else:
                    runs.append([i, i + width])
        out.append([(a, b) for a, b in runs])
    return out
