"""Plain versions of the contracts, for comparison on small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def op4(text):
    t = text or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    hit = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
    return out | {"base_failed": len(w) < 20 or 100 * len(hit) > 30 * len(w)}


KINDS = {
    "assign": (re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def op6(text):
    t = text or ""
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, g, least)) in enumerate(KINDS.items()) for m in p.finditer(t) if len(m.group(g)) >= least)
    out = {f"n_{kind}": sum(x[2] == kind for x in found) for kind in KINDS}
    return out | {"base_sha256": sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in found))}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def op3(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    shared = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((find(sets[a][0]), find(sets[b][0])))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}
