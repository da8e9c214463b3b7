"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And automaton of several 64-bit words: a bit per pattern position, a mask
per symbol, self-loops where a '*' stands. One pass over the symbols of a canonical URL moves all patterns at once;
a batch of URLs moves in lockstep, one row of words each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols are UTF-8 bytes, and between host and path one that no byte equals.
BORDER, SYMBOLS = 256, 257


@dataclass(frozen=True)
class UrlRule:
    """verdict for URLs that the pattern fits. name: shown in results, '' for the method's own rules."""

    verdict: str
    host: str  # glob over '.' + host
    path: str  # glob over the path
    name: str = ""


def prefix_rule(verdict: str, name: str) -> UrlRule:
    """'host/path': that host and its subdomains, paths that start so."""
    host, _, path = name.partition("/")
    return UrlRule(verdict, "*." + host, "/" + path + "*", name)


#: Fixed values of the query's contract.
BASE = tuple(prefix_rule(*x.split(" ")) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"))
#: The method's own verdicts where no base rule fits: pages that carry no prose of their own.
OWN_HOSTS = ("ads", "adserver", "adservice", "analytics", "doubleclick", "metrics", "pixel", "tracker", "tracking", "stats", "cdn", "static", "login", "sso", "auth")
OWN_PATHS = ("/login", "/logout", "/signin", "/signup", "/register", "/password", "/account/", "/cart/", "/basket/", "/checkout", "/wishlist", "/wp-admin/", "/wp-login", "/wp-json/", "/cgi-bin/", "/tag/", "/tags/", "/feed/", "/rss/", "/print/", "/share/", "/search/", "/embed/", "/calendar/")
OWN_ENDINGS = ("pdf", "zip", "gz", "tgz", "bz2", "rar", "7z", "tar", "exe", "msi", "dmg", "iso", "apk", "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "xml", "json", "mp3", "mp4", "avi", "mov", "webm", "wav", "woff", "woff2", "ttf")
OWN = (*(UrlRule("block", f"*.{h}.*", "*") for h in OWN_HOSTS), *(UrlRule("block", "*", f"*{x}*") for x in OWN_PATHS), *(UrlRule("block", "*", f"*.{x}") for x in OWN_ENDINGS))
#: Cells (URLs times the longest of them) of a block, and how many URLs at least move in lockstep.
CELLS, FEW = 1 << 21, 8


class Automaton:
    """Bits of a pattern: one per symbol; a '*' keeps the bit before it alive on any symbol. A start bit stands first."""

    def __init__(self, rules: Sequence[UrlRule]):
        bits = 0
        places: list[tuple[int, list[tuple[int, int]], list[int]]] = []
        for r in rules:
            start, at, put, loops = bits, bits, [], []
            for symbol in [*r.host.encode(), BORDER, *r.path.encode()]:
                if symbol == ord("*"):
                    loops.append(at)
                else:
                    at += 1
                    put.append((at, symbol))
            places.append((start, put, loops))
            bits = at + 1
        self.words = max(1, -(-bits // 64))
        one = lambda b: (b // 64, np.uint64(1) << np.uint64(b % 64))
        self.mask, self.first, self.loop = np.zeros((SYMBOLS, self.words), np.uint64), np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.last = []
        self.masks = [0] * SYMBOLS  # the same words as one number each, for URLs that go alone
        for start, put, loops in places:
            w, b = one(start)
            self.first[w] |= b
            for at, symbol in put:
                w, b = one(at)
                self.mask[symbol, w] |= b
                self.masks[symbol] |= 1 << at
            for at in loops:
                w, b = one(at)
                self.loop[w] |= b
            self.last.append(one(put[-1][0] if put else start))

    def fits(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """symbols: (n, longest) symbol codes; lengths: (n,). Returns (n, rules) booleans."""
        n = len(lengths)
        state = np.repeat(self.first[None, :], n, 0)
        order = np.argsort(-lengths, kind="stable")
        sorted_symbols, left = symbols[order], np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if n else 0) + 1), side="right")
        for k, live in enumerate(left):
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.mask[sorted_symbols[:live, k]]) | (s & self.loop)
        out = np.empty((n, len(self.last)), bool)
        out[order] = self._ends(state)
        return out

    def fits_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one URL of any length."""
        whole = lambda words: int.from_bytes(words.tobytes(), "little")
        state, loop, masks = whole(self.first), whole(self.loop), self.masks
        for c in symbols.tolist():
            state = ((state << 1) & masks[c]) | (state & loop)
        return self._ends(np.frombuffer(state.to_bytes(8 * self.words, "little"), np.uint64)[None, :])[0]

    def _ends(self, state: np.ndarray) -> np.ndarray:
        return np.stack([(state[:, w] & b) != 0 for w, b in self.last], 1) if self.last else np.empty((len(state), 0), bool)


def host_and_path(url: str | None) -> tuple[str, str]:
    """After the first :// the host, lower-cased A-Z, then the path up to ? or #; both empty without a ://."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def judge_batch(automaton: Automaton, rules: Sequence[UrlRule], urls: Sequence[str | None]) -> tuple[list, list, list, list]:
    """(hosts, paths, rules, verdicts). URLs of like length move in lockstep, in blocks of at most CELLS symbols; a few
    long ones go one by one."""
    parts = [host_and_path(u) for u in urls]
    codes = [np.concatenate([np.frombuffer(("." + h).encode(), np.uint8).astype(np.int16), [BORDER], np.frombuffer(p.encode(), np.uint8).astype(np.int16)]) for h, p in parts]
    lengths = np.array([len(c) for c in codes], np.int64)
    rule, verdict = [None] * len(codes), ["allow"] * len(codes)
    by_length = np.argsort(lengths, kind="stable")
    named = sorted((k for k, r in enumerate(rules) if r.name), key=lambda k: -len(rules[k].name))
    own = np.array([not r.name and r.verdict == "block" for r in rules], bool)
    at = 0
    while at < len(codes):
        end = at + 1
        while end < len(codes) and (end + 1 - at) * lengths[by_length[end]] <= CELLS:
            end += 1
        rows = by_length[at:end]
        if len(rows) < FEW:
            fits = np.stack([automaton.fits_one(codes[k]) for k in rows])
        else:
            wide = np.zeros((len(rows), int(lengths[rows].max())), np.int16)
            for i, k in enumerate(rows):
                wide[i, : lengths[k]] = codes[k]
            fits = automaton.fits(wide, lengths[rows])
        blocked = (fits & own).any(1)
        for i, k in enumerate(rows):
            if parts[k] != ("", ""):
                first = next((x for x in named if fits[i, x]), None)
                if first is not None:
                    rule[k], verdict[k] = rules[first].name, rules[first].verdict
                elif blocked[i]:
                    verdict[k] = "block"
        at = end
    return [h for h, _ in parts], [p for _, p in parts], rule, verdict


def filter_urls(pages: DataFrame, base: Sequence[UrlRule] = BASE, own: Sequence[UrlRule] = OWN) -> DataFrame:
    """page_id, host, path, rule (the longest named rule that fits, else null), verdict (its, else the own rules').

    A null URL, or one without ://, has an empty host and path, no rule, and is allowed. Repeated rows are judged
    alike; a null page_id is kept, and ids pass through as they are; other columns are ignored; no pages give no rows.
    A URL of any length is read whole; memory is bounded by the longest one, not by that times the others.
    """
    rules = (*base, *own)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for b in batches:
            said = judge_batch(automaton, rules, b.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(x, pa.string()) for x in said)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")


ORACLE_BASE = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p LEFT JOIN r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path) GROUP BY ALL)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN host = '' AND path = '' THEN 'allow'
  WHEN regexp_matches('.' || host, '\.({'|'.join(OWN_HOSTS)})\.') OR regexp_matches(path, '{'|'.join(OWN_PATHS)}|\.({'|'.join(OWN_ENDINGS)})$') THEN 'block'
  ELSE 'allow' END AS verdict FROM m
"""
