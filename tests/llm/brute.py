"""Plain Python versions of the contracts, straight from their wording."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(SPACE, text or "")


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(set(windows)) < len(windows) else set()
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def license_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def phrases(text: str | None, known: dict[str, str]) -> list[tuple[int, str]]:
    w = license_words(text)
    return sorted((i, label) for p, label in known.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def secrets(text: str | None) -> str:
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(SECRETS) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{SECRETS[i][0]}:{a}:{b}" for a, i, b in sorted(found))


def substrings(texts: dict[int, str | None], width: int = 50) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple[str, ...], int] = {}
    split = {i: words(texts[i]) for i in sorted(texts)}
    for i, w in split.items():
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint(data: bytes) -> str:
    """Chunks byte by byte: a hash of the last 7 bytes ends one where its low bits are ones."""
    ones = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 6) : i + 1]:
            h = (h * 2246822519 + (b + 1) * 2654435761) % 2**32
        h = (h ^ h >> 15) * 3266489917 % 2**32
        h ^= h >> 13
        ones.append(len(bin(~h & (h + 1))) - 3 if 6 <= i < len(data) - 1 else -1)
    k = 3
    while sum(x >= k for x in ones) >= 64:
        k += 1

    def letters(least: int) -> str:
        out, begin = "", 0
        for i, x in enumerate(ones):
            if x >= least or i == len(data) - 1:
                out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[zlib.crc32(data[begin : i + 1]) % 64]
                begin = i + 1
        return out

    return f"{k}:{letters(k)}:{letters(k + 1)}"


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def likeness(a: str, b: str) -> float:
    (ka, a1, a2), (kb, b1, b2) = a.split(":"), b.split(":")
    near = lambda x, y: 1 - edit_distance(x, y) / max(len(x), len(y), 1)
    if a == b:
        return 1.0
    return {0: max(near(a1, b1), near(a2, b2)), 1: near(a1, b2), -1: near(a2, b1)}.get(int(ka) - int(kb), 0.0)


def bayes(rows: list[tuple[str, str | None]], texts: list[str | None], bucket: dict[str, int], domains: list[str], buckets: int, smoothing: float, evidence: int) -> list[list[float]]:
    """Memberships of texts; rows: (domain, text) of the training documents."""
    split = lambda t: words((t or "").lower())
    held = [sum(d == x for x, _ in rows) for d in domains]
    prior = [math.log((h + 1) / (sum(held) + len(domains))) for h in held]
    counts = [[0] * buckets for _ in domains]
    for d, t in rows:
        for w in split(t):
            counts[domains.index(d)][bucket[w]] += 1
    like = [[math.log((c + smoothing) / (sum(x) + smoothing * buckets)) for c in x] for x in counts]
    out = []
    for t in texts:
        w = split(t)
        score = [p + min(1, evidence / max(1, len(w))) * sum(x[bucket[y]] for y in w) for p, x in zip(prior, like, strict=True)]
        odds = [math.exp(s - max(score)) for s in score]
        out.append([o / sum(odds) for o in odds])
    return out
