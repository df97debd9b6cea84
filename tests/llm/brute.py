"""Plain versions of the corpus operators, for small tables only."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, similarity):
    """{position: (set size, least id)} of (id, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                top[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(least[find(i)])) for i in range(len(rows))]


def counts(text):
    w = WORD.findall(text or "")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def repeats(texts, length=100):
    """{id: (bytes, removed, spans, sha of the rest)} of {id: text}."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for o in range(len(b) - length + 1):
            w = b[o : o + length]
            if w in seen:
                gone[o : o + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def line_dedup(texts, least=60):
    """{id: (lines, removed, text)}: a line goes if it stands in a run of lines that an earlier document holds as well."""
    lines = {i: [] if t is None else t.split("\n") for i, t in texts.items()}
    held, out = defaultdict(list), {}
    for i in sorted(texts):
        own, gone = lines[i], set()
        for k, x in enumerate(own):
            for j, p in held[x]:
                other = lines[j]
                if k and p and own[k - 1] == other[p - 1]:
                    continue  # not the first line of the run
                n = 0
                while k + n < len(own) and p + n < len(other) and own[k + n] == other[p + n]:
                    n += 1
                if sum(map(len, own[k : k + n])) >= least:
                    gone.update(range(k, k + n))
        for p, x in enumerate(own):
            held[x].append((i, p))
        out[i] = (len(own), len(gone), None if texts[i] is None else "\n".join(x for k, x in enumerate(own) if k not in gone))
    return out
