"""Configuration files of sources, splits and known issues as tables. They are small and read on the driver."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SOURCE = "id string, name string, issuer string, url string, former_names array<string>, amendments array<string>, original_url string, original_ref string"
ISSUE = "id string, source string, amendment_url string, amending_article string, operation string, madde_type string, madde string, fikra int, bent string, alt_bent int, cumle string, description string, place int"


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A row per source of the file's last version; amendments given as mappings count by their url."""
    names = [x.split(" ")[0] for x in SOURCE.split(", ")]
    rows = [[[a["url"] if isinstance(a, dict) else a for a in s.get(c) or []] if c == "amendments" else s.get(c) for c in names] for s in _load(_version_file(path, _latest(path))).get("sources") or []]
    return spark.createDataFrame(rows, SOURCE)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, source)."""
    return spark.createDataFrame([(k, s) for k, v in _load(path).items() for s in v or []], "split string, source string")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Known issues in the order of the file (place); what an issue's location does not list is null."""
    rows = []
    for k, i in enumerate(_load(path).get("issues") or []):
        at = i.get("location") or {}
        own = lambda c, at=at: None if at.get(c) is None else at[c] if c in ("fikra", "alt_bent") else str(at[c])
        rows.append((i.get("id"), i.get("source"), i.get("amendment_url"), None if i.get("amending_article") is None else str(i["amending_article"]), i.get("operation"), *map(own, ("madde_type", "madde", "fikra", "bent", "alt_bent", "cumle")), i.get("description"), k))
    return spark.createDataFrame(rows, ISSUE)


def _version_file(path: str, n: int) -> str:
    stem, ext = os.path.splitext(path)
    return f"{stem}.v{n:06d}{ext}" if n else path


def _latest(path: str) -> int:
    n = 0
    while os.path.exists(_version_file(path, n + 1)):
        n += 1
    return n


def write_sources(sources: DataFrame, path: str, tries: int = 20) -> int:
    """The rows of a table of sources into their file, by id, as its next version; JSON, which is YAML as well.

    Sources and fields that the table does not have stay as they are in the file, and so does all else in it; a null field
    or an empty list takes a known field out; ids that are new are appended. The version is a file of its own that one
    writer alone can create; who comes second reads again and tries the next. A few rows: a source is a regulation.
    """
    rows = {r["id"]: r.asDict(True) for r in sources.orderBy("id").toLocalIterator() if r["id"] is not None}
    for _ in range(tries):
        n = _latest(path)
        held = _load(_version_file(path, n)) if os.path.exists(_version_file(path, n)) else {}
        listed = list(held.get("sources") or [])
        known = {s.get("id") for s in listed}
        listed += [{"id": i} for i in rows if i not in known]
        for s in listed:
            for c, v in rows.get(s.get("id"), {}).items():
                if c == "amendments" and v and [a["url"] if isinstance(a, dict) else a for a in s.get(c) or []] == list(v):
                    continue
                if v in (None, []):
                    s.pop(c, None)
                else:
                    s[c] = v
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump({**held, "sources": listed}, f, ensure_ascii=False, indent=1)
        try:
            os.link(tmp, _version_file(path, n + 1))
            return n + 1
        except FileExistsError:
            continue
        finally:
            os.remove(tmp)
    raise OSError(f"{tries} tries to write {path}")
