"""Plain Python versions of the operators' definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def coded(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secret_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def luhn(digits):
    cells = [int(c) for c in reversed(digits)]
    return sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(cells)) % 10 == 0


def pii_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def words(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(n, links):
    least = list(range(n))

    def find(x):
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_duplicates(rows, percent=85):
    """{id: (size, component)} of (id, text) rows, ids distinct."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    links = []
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in owners[x] if j < i)
        links += [(i, j) for j, k in shared.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)]
    return {rows[i][0]: (len(sets[i]), rows[c][0]) for i, c in enumerate(components(len(rows), links))}


def near_vectors(rows, level=0.93):
    """{id: (links, component)} of (id, vector, label) rows, ids distinct."""
    rows = sorted(rows, key=lambda r: r[0])
    links = []
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            if label is not None and label == rows[j][2] and usable(v) and usable(rows[j][1]) and len(v) == len(rows[j][1]):
                a, b = np.array(v, float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= level:
                    links.append((i, j))
    counts = Counter(x for pair in links for x in pair)
    return {rows[i][0]: (counts[i], rows[c][0]) for i, c in enumerate(components(len(rows), links))}


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target} by sharing out again and again what is over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        given = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if given[s] > most * sizes[s]]
        if not over:
            return {**fixed, **given}
        fixed |= {s: most * sizes[s] for s in over}


def sainte_lague(wanted, blocks):
    """{source: seats} by the highest quotient, one block after the other."""
    names = sorted(wanted, key=lambda s: (s is None, s or ""))
    seats = dict.fromkeys(names, 0)
    for _ in range(blocks):
        best = max(names, key=lambda s: (wanted[s] / (2 * seats[s] + 1), -names.index(s)))
        seats[best] += 1
    return seats


def crc(text):
    return None if text is None else zlib.crc32(text.encode())


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())
