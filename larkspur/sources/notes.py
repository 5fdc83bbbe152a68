"""Notes and loose JSON: Markdown with its links and tags, and the JSON in what a model answers."""

from __future__ import annotations

import ast
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "struct<title:string,body:string,tags:array<string>,links:array<string>,embeds:array<string>,aliases:array<string>,created:string>"


def outside_fences(text: str) -> str:
    return re.sub(r"(?ms)^(```|~~~).*?(?:^\1\s*$|\Z)|`[^`\n]*`", "", text)


def distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def note(text: str | None, name: str = "") -> dict:
    """Title, text, tags, links, embeds, aliases and date of a note."""
    text = unicodedata.normalize("NFC", (text or "").replace("\r\n", "\n"))
    front: dict[str, list[str]] = {}
    m = re.match(r"---\n(.*?)\n---\n?", text, re.S)
    if m:
        key = ""
        for line in m[1].split("\n"):
            if (item := re.match(r"\s*-\s+(.*)", line)) and key:
                front[key].append(item[1].strip("\"' "))
            elif pair := re.match(r"(\w+):\s*(.*)", line):
                key = pair[1].lower()
                front[key] = [x.strip("\"' ") for x in pair[2].strip("[]").split(",") if x.strip()]
        text = text[m.end() :]
    text = re.sub(r"%%.*?%%", "", text, flags=re.S)
    prose = outside_fences(text)
    target = lambda x: re.split(r"[|#]", x)[0].strip()
    embeds = distinct(target(x) for x in re.findall(r"!\[\[([^\]]+)\]\]", prose))
    links = distinct(target(x) for x in re.findall(r"(?<!!)\[\[([^\]]+)\]\]", prose))
    tags = distinct([*(t.lstrip("#") for k in ("tags", "tag") for t in front.get(k, [])), *(t for t in re.findall(r"(?:^|\s)#([\w/-]+)", prose) if not t.isdigit())])
    heading = re.search(r"(?m)^#\s+(.+?)\s*#*$", prose)
    shown = re.sub(r"(?<!!)\[\[(?:[^\]|]*\|)?([^\]]+)\]\]", r"\1", re.sub(r"!\[\[[^\]]+\]\]", "", text))
    title = (front.get("title") or [heading[1] if heading else name])[0]
    return {"title": title, "body": shown.strip(), "tags": tags, "links": links, "embeds": embeds, "aliases": front.get("aliases", []), "created": (front.get("created") or front.get("date") or [None])[0]}


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """uri and note of every Markdown file below root, but for hidden folders, trash and templates."""

    @F.pandas_udf(NOTE)
    def parse(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([note(t, n) for t, n in zip(texts, names, strict=True)])

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).withColumn("uri", F.col("_metadata.file_path"))
    shown = files.where(~F.col("uri").rlike(r"/(\.[^/]+|Templates)/"))
    return shown.select("uri", parse("value", F.regexp_extract("uri", r"([^/]+)\.md$", 1)).alias("note")).select("uri", "note.*")


def loose_json(text: str | None) -> str | None:
    """The first JSON value in a text, repaired: fences, comments, trailing commas, Python's literals, cut ends."""
    text = text or ""
    fenced = re.findall(r"```(?:json)?\s*\n(.*?)(?:```|\Z)", text, re.S)
    for candidate in [*fenced, text, *(text[m.start() :] for m in re.finditer(r"[{\[]", text))]:
        value = _parsed(candidate.strip())
        if isinstance(value, (dict, list)):
            return json.dumps(value, ensure_ascii=False)
    return None


def _parsed(text: str):
    if not text.startswith(("{", "[")):
        return None
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', lambda m: m[1] or "", text, flags=re.S)
    for candidate in (text, bare, _closed(bare)):
        try:
            return json.JSONDecoder().raw_decode(candidate)[0]
        except ValueError:
            pass
        try:
            return ast.literal_eval(candidate)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            pass
    return None


def _closed(text: str) -> str:
    """A cut-off value with its strings and brackets closed."""
    open_, quoted, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    text += '"' * quoted
    if open_ and open_[-1] == "}":
        text = re.sub(r',\s*"[^"]*"\s*$', "", re.sub(r"[,:]\s*$", "", text))
    else:
        text = re.sub(r",\s*$", "", text)
    return text + "".join(reversed(open_))


def json_of(text: Column) -> Column:
    """loose_json as a column; null where there is no value."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(loose_json)

    return parse(text)
