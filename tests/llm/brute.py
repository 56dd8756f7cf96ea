"""Plain Python forms of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def words(text):
    return WORD.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def secrets(text):
    text = text or ""
    out = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    kinds = list(out)
    spans = sorted((s, kinds.index(k), e) for k, v in out.items() for s, e in v)
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
    return *(len(v) for v in out.values()), sha(joined.encode())


def substring(rows, size=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}: windows that start earlier go."""
    rows = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        out[doc_id] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return out


def suffix(rows, size=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}: strings that occur twice go, all of them."""
    data = {d: (t or "").encode() for d, t in rows}
    count = Counter(hash(b[i : i + size]) for b in data.values() for i in range(len(b) - size + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b) + 1)
        end = 0
        for i in range(len(b) - size + 1):
            if count[hash(b[i : i + size])] > 1:
                for j in range(max(i, end), i + size):
                    gone[j] = 1
                end = i + size
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows):
    """{doc_id: (n_shingles, component_id)} of all pairs with 100 * |A & B| >= 80 * |A | B|."""
    sets = {d: shingles(t) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for d, s in sets.items():
        shared = Counter(o for x in s for o in by[x] if o > d)
        for o, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(n - 9 * (n > 9) for n in doubled) % 10 == 0


def personal(text):
    """(start, kind, end) of the base kinds, 0 to 3: email, ip, card, phone."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def negatives(rows):
    """Rows of op11 for (vec_id, label, vector) with different ids."""
    kept = [(i, (n + 1) % 10 if i % 7 == 0 else n, [math.floor(256 * x) for x in v]) for i, n, v in rows if n is not None and usable(v)]
    out = []
    for i, n, v in kept:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == n][:5]:
            fit = [(x, k) for x, k, m in scored if m != n and 30 * -s <= 100 * -x <= 90 * -s][:10]
            out += [(i, j, rank, k, -s, -x) for rank, (x, k) in enumerate(fit, 1)]
    return sorted(out)


def vector_codes(rows, parts=8, entries=16, rounds=6):
    """Rows of op13 for (vec_id, label, vector)."""
    kept = [(i, n, [math.floor(4096 * x) for x in v]) for i, n, v in rows if usable(v)]
    width = max(len(v) for _, _, v in kept)
    size = -(-width // parts)
    kept = [(i, n, v + [0] * (size * parts - len(v))) for i, n, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    book = [[r[2][m * size : (m + 1) * size] for r in first] for m in range(parts)]

    def near(m, v):
        p = v[m * size : (m + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(book[m]))

    for _ in range(rounds):
        for m in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                own[near(m, v)[1]].append(v[m * size : (m + 1) * size])
            for k, ps in own.items():
                book[m][k] = [sum(c) // len(ps) for c in zip(*ps)]
    out, by = [], Counter()
    for i, n, v in kept:
        best = [near(m, v) for m in range(parts)]
        error = sum(d for d, _ in best)
        by[n] += error
        out.append((i, n, "".join(f"{k:02x}" for _, k in best), error))
    digest = sha(",".join(str(x) for m in book for e in m for x in e).encode())
    return sorted(((i, c, e, by[n], digest) for i, n, c, e in out), key=str)
