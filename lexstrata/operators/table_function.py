"""parse_units as a SQL table function, for LATERAL over a text or TABLE(...) PARTITION BY over the lines of documents.

It reads a text line by line with what is open at each level. Its rows are those of structure.parse_units, which is the
way to go for whole corpora; the function is for SQL users, and each call handles one text or one partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, OrderingColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lexstrata.operators.structure import ARTICLE, SECTION

NAMES = "article int, kind string, num string, key string, title string, section string, section_title string, fikra int, bent string, alt_bent int, text string"
ROW = [StructField(c, IntegerType() if k == "int" else StringType()) for c, k in (x.split(" ") for x in NAMES.split(", "))]
KINDS = {"G": "gecici", "E": "ek"}
HEADS = ("Değişik", "Ek", "Mülga", "İptal")
_ARTICLE, _SECTION = re.compile(ARTICLE.replace(r"\p{Lu}", "[A-ZÇĞİÖŞÜÂÎÛ]")), re.compile(SECTION)
_MARKED = re.compile(r"^[\"“]|^\(\d+\)|^([a-zçğıöşü])\1{0,2}\)|^\d+\)")
_UPPER = str.maketrans("iı", "İI")


def _is_note(inside: str) -> bool:
    head, colon, _ = inside.partition(":")
    words = head.split()
    at = next((i for i, w in enumerate(words[:4]) if w in HEADS), None)
    return bool(colon) and at is not None and all(w.isalpha() for w in words[:at]) and len(words) - at <= 5 and all(w.isalpha() and w.islower() for w in words[at + 1 :])


def _pieces(line: str) -> list[str]:
    return [p for p in re.split(r"(?=\()|(?<=\))", line) if p]


def _note(piece: str) -> bool:
    return piece.startswith("(") and piece.endswith(")") and _is_note(piece[1:-1])


def drop_notes(line: str) -> str:
    return "".join(" " if _note(p) else p for p in _pieces(line))


def _without_lead(line: str) -> tuple[str, str]:
    pieces = _pieces(line)
    n = next((i for i, p in enumerate(pieces) if p.strip() and not _note(p)), len(pieces))
    return "".join(pieces[:n]), "".join(pieces[n:]).lstrip()


def _is_footnote(line: str) -> bool:
    m = re.match(r"\((\d{1,3})\)\s*(\d{1,2}/\d{1,2}/\d{4})\s+(.*)", line)
    return bool(m) and m[3].startswith("tarihli") and "Resmî Gazete" in m[3].replace("Resmi", "Resmî") and any(w.startswith("madde") and ("siyle" in w or "sile" in w or "leriyle" in w or "lerile" in w) for w in m[3].split())


class Lines:
    """What is open while a text is read line by line; finished() gives its units in order."""

    def __init__(self) -> None:
        self.depth, self.straight = 0, False
        self.lines: list[tuple[str, bool]] = []

    def read(self, raw: str) -> None:
        line = " ".join(raw.replace(" ", " ").split())
        if not line:
            return
        head = bool(_ARTICLE.match(line))
        if head:
            self.straight = False
        self.lines.append((line, self.depth > 0 or self.straight))
        for c in line:
            self.depth += (c == "“") - (c == "”")
        self.depth = max(0, self.depth)
        if line.startswith('"') and not re.fullmatch('".*"', line):
            self.straight = True
        elif line.endswith('"') or head:
            self.straight = False

    def finished(self) -> Iterator[tuple]:
        kinds = [("head" if _ARTICLE.match(x) else "section" if _SECTION.match(x) else "footnote" if _is_footnote(x) else "") if not q else "quoted" for x, q in self.lines]
        begun = next((i for i, k in enumerate(kinds) if k in ("head", "section")), len(kinds))
        for i, (x, q) in enumerate(self.lines[:begun]):
            if q or (i > 0 and (x != x.translate(_UPPER).upper() or any(y != y.translate(_UPPER).upper() or z for y, z in self.lines[1:i]))):
                continue
            kinds[i] = "heading"
        section = section_title = title = None
        article, units, now = 0, {}, None
        for i, (line, quoted) in enumerate(self.lines):
            kind = kinds[i]
            if kind == "section":
                yield from self.rows(units, now)
                units, now, section, section_title = {}, None, line, line if i and kinds[i - 1] == "section" else None
                continue
            if i and kinds[i - 1] == "section" and kind != "head":
                section_title = line
                if kind != "heading" and now is None:
                    continue
            if kind == "head":
                yield from self.rows(units, now)
                article, m = article + 1, _ARTICLE.match(line)
                of = KINDS.get((m[1] or " ")[0].upper(), "normal")
                units, now = {}, (article, of, m[2], m[2] if of == "normal" else f"{of}:{m[2]}", title, section, section_title)
                self.fikra = self.bent = self.alt = None
                body = _without_lead(line[m.end() :])[1]
                body = re.sub(r"^\((\d+)\)\s*(?=\((\d+)\))", "", body)
                body = "" if re.fullmatch(r"\(\d+\)", body) else body
                title = None
            else:
                bare = drop_notes(line).strip()
                upcoming = i + 1 < len(kinds) and kinds[i + 1] == "head"
                if kind == "" and upcoming and not (i and kinds[i - 1] == "section") and len(bare) <= 250 and not bare.endswith((".", ",", ";", ":")) and not _MARKED.match(line):
                    title = bare
                    continue
                title = None
                if now is None or kind in ("footnote", "heading"):
                    continue
                lead, rest = _without_lead(line)
                m = re.match(r"\(\d+\)", rest)
                body = f"{m[0]} {lead.strip()}{rest[m.end() :]}" if lead and m else line
            self.place(units, body, quoted)
        yield from self.rows(units, now)

    def place(self, units: dict, body: str, quoted: bool) -> None:
        """body goes to the unit that its mark opens, or to the one that is open."""
        if not quoted:
            if m := re.match(r"\((\d+)\)\s*", body):
                self.fikra, self.bent, self.alt = int(m[1]), None, None
                body = body[m.end() :]
            elif m := re.match(r"(([a-zçğıöşü])\2{0,2})\)\s*", body):
                self.fikra, self.bent, self.alt = self.fikra or 1, m[1], None
                body = body[m.end() :]
            elif self.bent and (m := re.match(r"(\d+)\)\s*", body)):
                self.alt, body = int(m[1]), body[m.end() :]
        units.setdefault((self.fikra, self.bent, self.alt), []).append(body.strip())

    @staticmethod
    def rows(units: dict, now: tuple | None) -> Iterator[tuple]:
        for place, said in units.items():
            text = re.sub(r"(?<=[.,;:])\(\d{1,3}\)", "", drop_notes("\n".join(said)))
            yield (*now, *place, " ".join(text.split()))


class ParseUnits:
    """parse_units(text) or parse_units(TABLE(lines) PARTITION BY doc_id ORDER BY pos): the argument decides which."""

    def __init__(self) -> None:
        self.lines, self.of = None, None

    @staticmethod
    def analyze(source: AnalyzeArgument) -> AnalyzeResult:
        """A text gives ROW; a table (doc_id, pos, line) gives doc_id too, and is dealt by doc_id in the order of pos."""
        if not source.isTable:
            return AnalyzeResult(StructType(ROW))
        return AnalyzeResult(StructType([source.dataType["doc_id"], *ROW]), partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("pos")])

    def eval(self, source) -> Iterator[tuple]:
        if isinstance(source, str) or source is None:
            whole = Lines()
            for line in (source or "").split("\n"):
                whole.read(line)
            yield from whole.finished()
            return
        if self.lines is None:
            self.lines, self.of = Lines(), source["doc_id"]
        for line in (source["line"] or "").split("\n"):
            self.lines.read(line)

    def terminate(self) -> Iterator[tuple]:
        if self.lines is not None:
            for row in self.lines.finished():
                yield (self.of, *row)


def register(spark: SparkSession) -> None:
    """parse_units for the SQL of a session. Null and empty texts have no rows."""
    spark.udtf.register("parse_units", udtf(ParseUnits))
