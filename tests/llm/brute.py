"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secrets(text: str | None) -> tuple[int, int, int, str]:
    spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    count = Counter(k for _, k, _ in spans)
    return count[0], count[1], count[2], sha(",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in sorted(spans)))


def decontaminate(docs: dict, items: dict) -> dict:
    windows = defaultdict(set)
    for i, t in items.items():
        w = ALNUM_WORD.findall(lower(t or ""))
        for a in range(max(len(w) - 10, 0) + 1):
            if w[a : a + 10]:
                windows[tuple(w[a : a + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs.items():
        w = ALNUM_WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def substring(docs: dict, n: int = 20) -> dict:
    seen, out = set(), {}
    for d in sorted(docs):
        w = SPACE_WORD.findall(docs[d] or "")
        gone = set()
        for a in range(len(w) - n + 1):
            x = tuple(w[a : a + n])
            if x in seen:
                gone |= set(range(a, a + n))
            seen.add(x)
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text: str | None, k: int) -> frozenset:
    w = SPACE_WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs: dict, k: int) -> dict:
    sets = {d: shingles(t, k) for d, t in docs.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for ds in holders.values():
        ds.sort()
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}
