"""Amending sentences as tokens: references to units, quotes and verbs, and the operations they form.

A sentence is read once from left to right. Values (numbers, ordinals, letters) gather until a unit noun takes them;
the noun's case tells its part: a genitive opens a context, an ablative is an anchor, any other ending makes a target.
Verbs and their adverbs close an operation over what was gathered since the one before.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

from lexstrata.functions.text import ORDINALS, unit_name_of

LEVELS = ("madde", "fikra", "bent", "alt_bent", "cumle")
EMPTY = {"madde_type": "normal", "madde": [], "fikra": [], "bent": [], "alt_bent": [], "cumle": []}
#: The first letters of ordinals and unit nouns: only where one stands are their words tried.
_FIRST, _UNIT_FIRST = "".join(sorted({w[0] for w in ORDINALS})), "abcefgim"
_ORDINAL = "|".join(sorted((w.replace(" ", r"\s+") for w in ORDINALS), key=lambda w: (-len(w), w)))
#: How the tokens of an amending sentence are written.
TOKENS = re.compile(
    rf"""(?P<quote>“(?:[^“”]|“[^“”]*”)*”|"[^"]*")
    |(?P<annex>\b[Ee][Kk]-\d+(?:[-/][A-Z]\b)?)(?P<tail>[’'`][a-zçğıöşü]+)?
    |(?P<letter>\([a-zçğıöşü]{{1,3}}\))|(?P<number>\((\d+)\)|\b\d+(?:/[A-ZÇĞİÖŞÜ])?\b(?![/.]\d))
    |(?P<ordinal>(?=(?i:[{_FIRST}]))\b(?i:{_ORDINAL})\b)
    |(?P<unit>(?=(?i:[{_UNIT_FIRST}]))\b(?i:alt\s+ben[td]|geçici\s+madde|ek\s+madde|madde|fıkra|ben[td]|cümle|başlı[kğ]|ibare)(?P<ending>[a-zçğıöşü]*))
    |(?P<name>\b(?:Yönetmeli|Tebli)ğ(?:in(?:in)?|(?:in)?e)\b|\b(?:Yönetmeli|Tebli)ği?\s*\([^)]*\)\s*[’'`]\w+)
    |(?P<stop>\.(?=\s|$))|(?P<comma>[,;])|(?P<word>\w+)""", re.X)  # fmt: skip
#: A quote as TOKENS has it, and a regulation's name whose bracket holds a mark of one.
QUOTE, NAME_WITH_QUOTE = re.compile(r'''“(?:[^“”]|“[^“”]*”)*”|"[^"]*"'''), re.compile(r'''(?:Yönetmeli|Tebli)ği?\s*\([^)]*[“"]''')
SUFFIX = re.compile("[ıiuü]?nc[ıiuü]")


def low(s: str) -> str:
    return s.replace("I", "ı").replace("İ", "i").lower()


def tokens(sentence: str) -> list[tuple[str, str, str]]:
    """(kind, value, ending) of each token."""
    out = []
    for m in TOKENS.finditer(sentence):
        kind, value, ending = m.lastgroup, m.group(), ""
        if m["quote"]:
            kind, value = "quote", value[1:-1]
        elif m["annex"]:
            kind, value, ending = "annex", m["annex"].upper(), m["tail"] or ""
        elif m["letter"] or m["number"]:
            kind, value = ("letter", value[1:-1]) if m["letter"] else ("inner" if value[0] == "(" else "number", value.strip("()"))
        elif m["ordinal"]:
            kind, value = "ordinal", str(ORDINALS[re.sub(r"\s+", " ", low(value))])
        elif m["unit"]:
            kind, value, ending = "unit", unit_name_of(low(value)), low(m["ending"])
        elif m["name"]:
            kind = "name"
        elif kind == "word":
            value = low(value)
        out.append((kind, value, ending))
    return out


#: Endings of unit nouns by case, longest first where they share a tail.
ANCHOR, CONTEXT = re.compile("n?[dt][ae]n$"), re.compile("(?:s[ıi]|[ıiuü]|l[ae]r[ıi]|l[ae]r)?n[ıiuü]n$")


def _wipe(place: dict, level: str) -> dict:
    at = LEVELS.index(level)
    return {k: [] if k in LEVELS[at + 1 :] else v for k, v in place.items()}


class Reader:
    """One pass over the tokens; place is the location that later references inherit from."""

    def __init__(self, place: dict):
        self.place, self.records, self.start = {**place}, [], True
        self.fresh()

    def fresh(self) -> None:
        """After an operation: nothing gathered."""
        self.values, self.kind, self.targets, self.quotes, self.said = [], None, [], [], []
        self.after, self.annex, self.parted, self.where, self.named = None, [], True, None, False
        self.unit = self.new = self.below = self.side = None
        self.many = False

    def refer(self, unit: str, ending: str) -> None:
        level = {"gecici_madde": "madde", "ek_madde": "madde"}.get(unit, unit)
        values = [v for k, v in self.values if k in {"madde": ("number",), "fikra": ("ordinal", "number"), "bent": ("letter",), "alt_bent": ("inner",), "cumle": ("ordinal",)}[level]]
        kind = self.kind or {"gecici_madde": "gecici", "ek_madde": "ek"}.get(unit)
        self.values, self.kind = [], None
        if not values:
            return
        if ANCHOR.search(ending):
            self.after = values[-1]
            return
        self.place = _wipe({**self.place, level: values}, level)
        if level == "madde":
            self.place["madde_type"], self.named = kind or "normal", True
        if CONTEXT.search(ending):
            return
        if self.targets and not self.parted:
            self.targets.pop()
        self.targets.append((dict(self.place), level))
        self.parted = False

    def add(self, operation: str, unit: str | None, **fields) -> None:
        targets = self.targets or [(dict(self.place), None)]
        self.records.append({"operation": operation, "unit": unit, "targets": targets, "insert_after": self.after, "annex": self.where, "named": self.named, **fields})
        self.place = {**targets[-1][0], **{k: targets[-1][0][k][-1:] for k in LEVELS}}
        self.fresh()

    def read(self, sentence: str) -> list[dict]:
        return self.follow(tokens(sentence))

    def follow(self, line: list[tuple]) -> list[dict]:
        adds, adds_later = False, []
        for kind, value, _ in reversed(line):
            adds = (adds and kind != "stop") or (kind == "word" and value.startswith("eklenmiş"))
            adds_later.append(adds)
        adds_later.reverse()
        for i, (kind, value, ending) in enumerate(line):
            if kind == "word" and value not in ("ve", "ile", "numaralı", "geçici", "ek") and not SUFFIX.fullmatch(value):
                self.values, self.kind = [], None
            if kind == "name":
                self.fresh()
            elif kind in ("number", "ordinal", "letter", "inner"):
                self.values.append((kind, value))
            elif kind == "annex":
                self.annex.append(value)
                if ending:
                    self.where = value
            elif kind == "quote":
                self.quotes.append(value)
            elif kind == "word" and value in ("geçici", "ek"):
                self.kind = {"geçici": "gecici"}.get(value, value)
            elif kind == "unit" and value == "ibare":
                self.said.append("anchor" if ANCHOR.search(ending) else "phrase")
                if self.said[-2:] == ["side", "phrase"] and len(self.quotes) >= 2 and adds_later[i]:
                    self.add("IBARE_EKLE", "ibare", anchor_text=self.quotes[-2], anchor_position=self.side, new_text=self.quotes[-1])
            elif kind == "unit" and value == "baslik":
                self.unit = value
                self.said.append("title")
            elif kind == "unit":
                self.unit = value
                if "below" not in self.said or value.endswith("madde"):
                    self.refer(value, ending)
                    if "below" in self.said and self.targets:
                        self.new = self.targets.pop()[0]
            elif kind == "word":
                said = self.said
                if value in ("sonra", "önce") and said[-1:] == ["anchor"]:
                    said.append("side")
                    self.side = value
                elif value in ("şeklinde", "şeklide", "olarak") and said[-1:] == ["phrase"] and len(self.quotes) >= 2:
                    self.add("IBARE_DEGISTIR", "ibare", old_text=self.quotes[-2], new_text=self.quotes[-1])
                elif value == "şeklinde" and said[-1:] == ["title"] and self.quotes:
                    self.add("BASLIK_DEGISTIR", "baslik", new_text=self.quotes[-1])
                elif value in ("aşağıdaki", "aşağıda") and line[i + 1 : i + 2] != [("word", "düzenlemeler", "")]:
                    said.append("below")
                    self.below, self.unit = self.unit, None
                elif value == "birlikte" and said[-1:] == ["title"]:
                    said.pop()
                    self.unit = "madde"
                elif value.startswith("değiştirilmiş"):
                    if "ekteki" in said:
                        self.annexes("EK_DEGISTIR")
                    elif "below" in said:
                        self.add("BIRIM_DEGISTIR", self.below, block=True, plural=self.many)
                elif value.startswith("eklenmiş"):
                    if "below" in said and self.unit:
                        self.add("BIRIM_EKLE", self.unit, block=True, new=self.new, plural=self.many)
                    elif self.annex:
                        self.annexes("EK_EKLE")
                elif value == "ekteki":
                    said.append(value)
                elif value.startswith(("kaldırılmış", "çıkarılmış")):
                    if said[-1:] == ["phrase"] and self.quotes:
                        self.add("IBARE_KALDIR", "ibare", old_text=self.quotes[-1])
                    elif self.unit and value[0] == "k":
                        self.add("BIRIM_KALDIR", self.unit)
            if kind == "unit" and value != "ibare":
                self.many = "lar" in ending or "ler" in ending
            if kind == "comma" or (kind == "word" and value in ("ve", "ile")):
                self.parted = self.parted or bool(self.targets)
        return self.records

    def annexes(self, operation: str) -> None:
        self.targets = [({**EMPTY, "madde_type": "ek_belge", "madde": [a]}, None) for a in self.annex]
        self.where = None
        before = self.place
        self.add(operation, "ek")
        self.place = before


def outer_quotes(block: str) -> list[str]:
    """What stands between outermost quotation marks; straight ones count where there are no curly ones."""
    if "“" not in block:
        return [q.strip() for q in re.findall(r'"([^"]*)"', block)]
    out, depth, start = [], 0, 0
    for m in re.finditer("[“”]", block):
        if m.group() == "“":
            start, depth = (m.end() if depth == 0 else start), depth + 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(block[start : m.start()].strip())
    return out


def by_marker(text: str, wanted: list[dict]) -> list[str] | None:
    """The part of text under each target's own marker, if all targets are of one level and all have one."""
    for level, mark in (("alt_bent", r"(\d+)\)"), ("bent", r"([a-zçğıöşü]{1,3})\)"), ("fikra", r"\((\d+)\)")):
        if all(w[level] is not None for w in wanted):
            parts = re.split(rf"(?m)^[ \t]*(?={mark}\s)", text)
            found: dict[str, str] = {}
            for p in parts:
                if p and (m := re.match(mark, p)):
                    found.setdefault(m[1], p.strip())
            keys = [str(w[level]) for w in wanted]
            return [found[k] for k in keys] if all(k in found for k in keys) else None
    return None


def places(record: dict) -> list[tuple[dict, str | None]]:
    """(location, unit of its last reference) for every combination of a record's lists."""
    out = []
    for place, level in record["targets"]:
        for m, f, b, a in product(*(place[k] or [None] for k in LEVELS[:4])):
            at = {"madde_type": place["madde_type"], "madde": m, "fikra": int(f) if f else None, "bent": b, "alt_bent": int(a) if a else None, "cumle": ",".join(place["cumle"]) or None}
            if record["annex"]:
                at |= {"madde_type": "ek_belge", "madde": record["annex"]}
            out.append((at, level))
    return out


def share(quotes: list[str], blocks: list[tuple[list[dict], bool]]) -> list[list[str]]:
    """The texts of each block operation: blocks are (its places, whether its noun is plural)."""
    n = [len(p) for p, _ in blocks]
    if len(blocks) == 1 and n[0] > 1 and n[0] != len(quotes):
        own = by_marker("\n".join(quotes), blocks[0][0])
        if own:
            return [own]
    spare, cut = len(quotes) - sum(n), []
    if spare and len(blocks) == len(quotes):
        return [[q] * k for q, k in zip(quotes, n, strict=True)]
    taker = max((i for i, (_, plural) in enumerate(blocks) if plural), default=None)
    if spare and (spare < 0 or taker is None):
        return [["\n".join(quotes)] * k for k in n]
    rest = iter(quotes)
    for i, k in enumerate(n):
        own = [next(rest) for _ in range(k + (spare if i == taker else 0))]
        cut.append(own if len(own) == k else ["\n".join(own)] * k)
    return cut


@lru_cache(maxsize=4096)
def forms(said: str, n: int, place: tuple) -> list[dict] | None:
    """What Reader finds in a sentence whose n quotes are emptied, with their numbers for their texts and its places as at;
    null where the sentence would be read otherwise than with its quotes. Not to be changed by callers."""
    quotes = QUOTE.findall(said)
    if len(quotes) != n or any(len(q) > 2 for q in quotes) or NAME_WITH_QUOTE.search(said):
        return None
    line, k = [], 0
    for token in tokens(said):
        line.append(("quote", k, "") if token[0] == "quote" else token)
        k += token[0] == "quote"
    return [{**r, "at": places(r)} for r in Reader({k: v if k == "madde_type" else list(v) for k, v in place}).follow(line)]


def operations(sentence: str, place: dict) -> list[dict]:
    """The operations that Reader finds, with their places as at. Amending sentences say the same but for their quotes, so
    those are emptied, and what is left is read once by each worker."""
    quotes: list[str] = []

    def emptied(m: re.Match) -> str:
        quotes.append(m.group()[1:-1])
        return m.group()[0] + m.group()[-1]

    said = QUOTE.sub(emptied, sentence)
    found = forms(said, len(quotes), tuple((k, v if k == "madde_type" else tuple(v)) for k, v in place.items()))
    if found is None:
        return [{**r, "at": places(r)} for r in Reader(place).read(sentence)]
    return [{k: quotes[v] if k.endswith("_text") and v is not None else v for k, v in r.items()} for r in found]


def records_of(sentence: str, block: str, place: dict | None = None) -> list[dict]:
    """The amendment records of a sentence whose quoted texts are in block, in order."""
    found, quotes = operations(sentence, place or EMPTY), outer_quotes(block)
    blocks = [r for r in found if r.get("block")]
    bare = re.sub(r"[ \t]+", " ", block.strip().strip("“”\"")).strip() or None
    texts = share(quotes, [([at for at, _ in r["at"]], r.get("plural", False)) for r in blocks]) if quotes else [[bare] * len(r["at"]) for r in blocks]
    for r, t in zip(blocks, texts, strict=True):
        r["texts"] = t
    out = []
    for r in found:
        for k, (at, level) in enumerate(r["at"]):
            unit = r["unit"]
            if r["operation"] in ("BIRIM_DEGISTIR", "BIRIM_KALDIR") and unit != "baslik" and level:
                unit = level
            keep = LEVELS
            if unit == "baslik":
                keep = LEVELS[:1]
            elif r["operation"] == "BIRIM_EKLE":
                new = r.get("new")
                if unit.endswith("madde"):
                    at, keep = ({**at, "madde_type": new["madde_type"], "madde": new["madde"][0]} if new else {**at, "madde_type": "normal"}), LEVELS[: 1 if new or r["named"] else 0]
                else:
                    keep = LEVELS[: LEVELS.index(unit)] if unit in LEVELS[:4] else LEVELS
            at = {k: v if k == "madde_type" or k in keep else None for k, v in at.items()}
            text = r["texts"][k] if r.get("block") else r.get("new_text")
            out.append({"operation": r["operation"], "unit": unit, **at, "old_text": r.get("old_text"), "new_text": text, "anchor_text": r.get("anchor_text"), "anchor_position": r.get("anchor_position"), "insert_after": r["insert_after"] if r["operation"] == "BIRIM_EKLE" else None})
    return out


def article_records(sentence: str, block: str) -> list[dict]:
    """records_of, or, where the sentence only announces lettered amendments of an article, those of each of them."""
    line = tokens(sentence) if "düzenlemeler" in low(sentence) else []
    if not any(line[i][1] == "aşağıdaki" and line[i + 1][1] == "düzenlemeler" for i in range(len(line) - 1)):
        return records_of(sentence, block)
    reader = Reader(EMPTY)
    reader.read(sentence)
    items: list[list[str]] = []
    depth = 0
    for text in block.split("\n"):
        item = re.match(r"[a-zçğıöşü]\)\s+(.+)", text) if depth == 0 else None
        if item:
            items.append([item[1]])
        elif items:
            items[-1].append(text)
        depth = max(0, depth + text.count("“") - text.count("”"))
    return [r for head, *rest in items for r in records_of(head, "\n".join(rest), reader.place)]
