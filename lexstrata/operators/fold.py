"""The fold of one article: its units under its records, in order.

An article is a title and a list of units; a unit is its levels, its lines, and the step at which it came and went.
Every change replaces units, so an earlier step can always be read again.
"""

from __future__ import annotations

import re
from itertools import count

from lexstrata.functions.text import ALPHABET, letter_after

APPLIED, NO_TARGET, NO_TEXT, UNSUPPORTED = "uygulandi", "hedef_bulunamadi", "metin_bulunamadi", "desteklenmiyor"
KEYS = ("fikra", "bent", "alt_bent")
ARTICLE_UNITS = ("madde", "maddeler", "gecici_madde", "ek_madde")


def sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.:])\s+", text.strip())


def _rank(letter: str) -> tuple[int, int]:
    return len(letter), ALPHABET.find(letter[0])


class Article:
    def __init__(self, title: str | None, units: list[dict]):
        self.title, self.live = title, [dict(u, since=0) for u in units]
        self.past: list[dict] = []
        self.titles: list[dict] = [{"title": title, "since": 0}]
        self.step = 0

    def put(self, at: int, gone: int, new: list[dict]) -> None:
        """new in place of the units at .. at + gone."""
        for u in self.live[at : at + gone]:
            if u["since"] < self.step:
                self.past.append(dict(u, until=self.step))
        self.live[at : at + gone] = [{**{k: u.get(k) for k in (*KEYS, "raw")}, "since": self.step} for u in new]

    def say(self, at: int, raw: str) -> None:
        self.put(at, 1, [{**self.live[at], "raw": raw}])

    def entitle(self, title: str | None) -> None:
        self.title = title
        self.titles.append({"title": title, "since": self.step})

    def span(self, r: dict, strict: bool) -> tuple[int, int] | None:
        """(first, number) of the units a record means; lax: of the deepest level that is there."""
        first, n = 0, len(self.live)
        if not n:
            return None
        for k in KEYS:
            if r[k] is None:
                continue
            hit = [i for i in range(first, first + n) if self.live[i][k] == r[k]]
            if not hit:
                return None if strict else (first, n)
            first, n = hit[0], 1
            own = [self.live[first][x] for x in KEYS[: KEYS.index(k) + 1]]
            while first + n < len(self.live) and [self.live[first + n][x] for x in KEYS[: len(own)]] == own:
                n += 1
        return first, n

    def phrase(self, r: dict) -> str:
        at = self.span(r, False)
        if at is None:
            return NO_TARGET
        old = r["anchor_text"] if r["operation"] == "IBARE_EKLE" else r["old_text"]
        if not old:
            return UNSUPPORTED if r["operation"] == "IBARE_EKLE" else NO_TEXT
        new, hit = r["new_text"] or "", False
        for i in range(at[0], at[0] + at[1]):
            raw = self.live[i]["raw"]
            parts, k = [raw], 0
            if (r["cumle"] or "").isdigit() and len(s := sentences(raw)) >= int(r["cumle"]):
                parts, k = s, int(r["cumle"]) - 1
            if old not in parts[k]:
                continue
            if r["operation"] == "IBARE_DEGISTIR":
                parts[k] = parts[k].replace(old, new)
            elif r["operation"] == "IBARE_KALDIR":
                parts[k] = re.sub(r"[ \t]{2,}", " ", parts[k].replace(old, "")).strip()
            else:
                both = f"{new} {old}" if r["anchor_position"] == "önce" else f"{old} {new}"
                parts[k] = parts[k].replace(old, both, 1)
            self.say(i, " ".join(parts))
            hit = True
            if r["operation"] == "IBARE_EKLE":
                break
        return APPLIED if hit else NO_TEXT

    def sentence(self, r: dict) -> str:
        at, wanted = self.span(r, True), r["cumle"].split(",")
        if at is None:
            return NO_TARGET
        drop = r["operation"] == "BIRIM_KALDIR"
        if not all(w.isdigit() for w in wanted) or (len(wanted) > 1 and not drop):
            return UNSUPPORTED
        if not drop and not r["new_text"]:
            return UNSUPPORTED
        said = sentences(self.live[at[0]]["raw"])
        if max(map(int, wanted)) > len(said):
            return NO_TARGET
        new = [] if drop else [r["new_text"].strip()]
        self.say(at[0], " ".join(x for i, s in enumerate(said, 1) for x in (new if str(i) in wanted else [s])))
        return APPLIED

    def blocks(self, r: dict, level: str) -> list[list[dict]]:
        """The parsed new text in groups of one paragraph, item or sub-item, under the record's own place."""
        out: list[list[dict]] = []
        for u in r["parsed"]:
            u = {**u, **{k: r[k] for k in KEYS[: KEYS.index(level)]}}
            if level == "bent" and u["fikra"] is None:
                u["fikra"] = 1
            if u[level] is None:
                if level == "fikra" and r["fikra"] is None:
                    continue
                u[level] = r[level]
            if u[level] is None:
                continue
            if out and all(out[-1][0][k] == u[k] for k in KEYS[: KEYS.index(level) + 1]):
                out[-1].append(u)
            else:
                out.append([u])
        return out

    def replace(self, r: dict) -> str:
        if not r["new_text"]:
            return UNSUPPORTED
        if r["unit"] == "baslik":
            return self.retitle(r)
        level = next((k for k in reversed(KEYS) if r[k] is not None), None)
        at = self.span(r, True)
        if at is None:
            return NO_TARGET
        if level is None:
            self.put(at[0], at[1], r["parsed"])
            if r["parsed_title"]:
                self.entitle(r["parsed_title"])
            return APPLIED
        new = [u for b in self.blocks(r, level) for u in b]
        if not new:
            return UNSUPPORTED
        last, old = new[-1], self.live[at[0] + at[1] - 1]["raw"].split("\n")
        if level == "bent" and len(old) > 1 and old[-1].endswith((".", ":")) and not last["raw"].endswith((".", ":")):
            last["raw"] += "\n" + "\n".join(old[1:])
        self.put(at[0], at[1], new)
        return APPLIED

    def retitle(self, r: dict) -> str:
        if not self.live:
            return NO_TARGET
        if r["parsed_head"]:
            self.put(0, len(self.live), r["parsed"])
            self.entitle(r["parsed_title"] or self.title)
            return APPLIED
        lines = r["new_text"].strip().split("\n")
        self.entitle(lines[0].strip())
        return self.paragraphs(r) if len(lines) > 1 else APPLIED

    def paragraphs(self, r: dict) -> str:
        """Paragraphs that are there are replaced; the others come after insert_after, or at the end."""
        where = None
        for block in self.blocks({**r, "fikra": None, "bent": None, "alt_bent": None}, "fikra"):
            hit = self.span({"fikra": block[0]["fikra"], "bent": None, "alt_bent": None}, True)
            if hit:
                self.put(*hit, block)
            else:
                if where is None:
                    anchor = str(r["insert_after"] or "")
                    found = self.span({"fikra": int(anchor), "bent": None, "alt_bent": None}, True) if anchor.isdigit() else None
                    where = sum(found) if found else len(self.live)
                self.put(where, 0, block)
                where += len(block)
        return APPLIED

    def items(self, r: dict, level: str) -> str:
        """Items come after insert_after, or at the end of their scope, whose closing words stay last; later letters move on."""
        scope = {k: r[k] if k in KEYS[: KEYS.index(level)] else None for k in KEYS}
        at = self.span(scope, False)
        if at is None:
            return NO_TARGET
        held = self.live[at[0]]
        new = [u for b in self.blocks({**r, **{k: held[k] for k in KEYS[: KEYS.index(level)]}}, level) for u in b]
        if not new:
            return UNSUPPORTED
        places = [i for i in range(at[0], sum(at)) if r["insert_after"] and str(self.live[i][level]) == str(r["insert_after"])]
        where = places[-1] + 1 if places else sum(at)
        before = self.live[where - 1]
        tail = before["raw"].split("\n")
        if before[level] is not None and where == sum(at) and len(tail) > 1 and tail[-1].endswith((".", ":")):
            self.say(where - 1, tail[0])
            new[-1]["raw"] += "\n" + "\n".join(tail[1:])
        self.put(where, 0, new)
        if level == "bent":
            self.shift(where + len(new), sum(at) + len(new), new[-1]["bent"])
        return APPLIED

    def shift(self, first: int, end: int, last: str) -> None:
        """Letters from first on move up while they are not above the letter before them; none is made up after the last."""
        of, moved = None, None
        for i in range(first, end):
            u = self.live[i]
            if u["bent"] is None:
                continue
            if u["bent"] != of:
                of = u["bent"]
                if _rank(of) > _rank(last) or letter_after(last) is None:
                    return
                last = moved = letter_after(last)
            self.put(i, 1, [{**u, "bent": moved}])

    def add(self, r: dict) -> str:
        if not r["new_text"]:
            return UNSUPPORTED
        if r["unit"] in ARTICLE_UNITS:
            if not r["base_found"]:
                return NO_TARGET
            if not r["parsed"]:
                return UNSUPPORTED
            self.put(0, len(self.live), r["parsed"])
            self.entitle(r["parsed_title"] or self.title)
            return APPLIED
        if not self.live:
            return NO_TARGET
        if r["unit"] in ("bent", "alt_bent"):
            return self.items(r, r["unit"])
        return self.paragraphs(r) if r["unit"] == "fikra" else UNSUPPORTED

    def apply(self, r: dict) -> str:
        self.step += 1
        op = r["operation"]
        if op.startswith("EK_"):
            return UNSUPPORTED
        if op.startswith("IBARE_"):
            return self.phrase(r)
        if op == "BASLIK_DEGISTIR":
            if not self.live:
                return NO_TARGET
            self.entitle((r["new_text"] or "").strip())
            return APPLIED
        if op in ("BIRIM_DEGISTIR", "BIRIM_KALDIR") and r["cumle"]:
            return self.sentence(r)
        if op == "BIRIM_DEGISTIR":
            return self.replace(r)
        if op == "BIRIM_EKLE":
            return self.add(r)
        if op == "BIRIM_KALDIR":
            at = self.span(r, True)
            if at is None:
                return NO_TARGET
            self.put(*at, [])
            return APPLIED
        return UNSUPPORTED


def fold(title: str | None, units: list[dict], records: list[dict]) -> tuple[list[str], list[dict], list[dict]]:
    """(status of each record, unit versions with since and until, titles with since). until is null for what stands."""
    article = Article(title, units)
    said = [article.apply(r) for r in records]
    order, versions = count(), [*article.past, *(dict(u, until=None) for u in article.live)]
    return said, [{**v, "ord": next(order)} for v in versions], article.titles
