"""Files of many kinds as rows: addresses, listings, plain texts, tables as documents, small settings, event streams."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that Spark's binaryFile reader gives without opening a file.
LISTED = ("path", "modificationTime", "length")


def address(uri: Column) -> Column:
    """scheme, root and rest of an abstract address such as obsidian://Vault/notes/a.md; null where it isn't one or climbs
    out by a `..`."""
    part = lambda i: F.regexp_extract(uri, r"^([a-z][a-z0-9+.-]*)://([^/]+)/(.+)$", i)
    sound = uri.rlike(r"^[a-z][a-z0-9+.-]*://[^/]+/.+$") & ~uri.rlike(r"(^|/)\.\.(/|$)|[\x00\\]")
    return F.when(sound, F.struct(part(1).alias("scheme"), part(2).alias("root"), part(3).alias("rest")))


def resolved(uri: Column, roots: dict[str, str]) -> Column:
    """Where an abstract address lies, by the folder of its scheme and root ("obsidian://Vault"); null for unknown ones."""
    where, at = F.create_map(*[F.lit(x) for pair in roots.items() for x in pair]), address(uri)
    return F.concat(F.try_element_at(where, F.concat(at["scheme"], F.lit("://"), at["root"])), F.lit("/"), at["rest"])


def listing(spark: SparkSession, path: str, prefix: str = "", pruned: tuple[str, ...] = (".git", "node_modules", ".venv")) -> DataFrame:
    """path, name (below the folder), modificationTime, length of all files under a folder whose name starts with prefix;
    nothing is opened, and folders called as in pruned are left out."""
    if ".." in prefix.split("/"):
        raise ValueError("a prefix can't climb out of its folder")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(*LISTED)
    name = F.regexp_replace(F.col("path"), f"^.*?{re.escape(path.rstrip('/').split('://')[-1])}/", "")
    out = rows.withColumn("name", name).where(F.startswith("name", F.lit(prefix)))
    return out.where(~F.arrays_overlap(F.split("name", "/"), F.array(*[F.lit(p) for p in pruned]))) if pruned else out


def uploads(spark: SparkSession, path: str, suffixes: tuple[str, ...], most_bytes: int) -> DataFrame:
    """path, length, sha256 and problem of the files of a folder: "type" for a suffix that isn't allowed, "size" for one
    that is too large, else null; only files without a problem are opened and hashed."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = spark.read.format("binaryFile").load(path)
    problem = F.when(~suffix.isin(*suffixes), "type").when(F.col("length") > most_bytes, "size")
    good, bad = rows.where(suffix.isin(*suffixes) & (F.col("length") <= most_bytes)), rows.select(*LISTED).withColumn("problem", problem).where("problem IS NOT NULL")
    told = good.select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("problem"))
    return told.unionByName(bad.select("path", "length", F.lit(None).cast("string").alias("sha256"), "problem"))


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: every file is one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def table_document(rows: DataFrame, most: int = 50) -> DataFrame:
    """A table as one document: text (a line of names, then the first rows, cells apart by " | ", and a note where there
    are more), columns, rows, truncated. rows have `_row` and columns of text."""
    names = [c for c in rows.columns if c != "_row"]
    line = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
    first = rows.orderBy("_row").limit(most).select("_row", line.alias("line"))
    body = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("_row", "line"))), lambda x: x["line"]).alias("lines"))  # `most` rows
    n = rows.agg(F.count("*").alias("rows"))
    note = F.when(F.col("rows") > most, F.format_string("(%d more rows)", F.col("rows") - most))
    text = F.concat_ws("\n", F.lit(" | ".join(names)), F.array_join("lines", "\n"), note)
    return body.crossJoin(F.broadcast(n)).select(text.alias("text"), F.array(*[F.lit(c) for c in names]).alias("columns"), "rows", (F.col("rows") > most).alias("truncated"))  # one row each


def parser_of(path: Column, parsers: dict[str, str]) -> Column:
    """The parser for a file's suffix; null for a suffix that none is for."""
    names = F.create_map(*[F.lit(x) for pair in parsers.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def parsed_by(files: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """files (path, ...) sent to the parser of their suffix; what the parsers return is put together, others are left out."""
    chosen, out = files.withColumn("_parser", parser_of(F.col("path"), {s: s for s in parsers})), None
    for suffix, parse in parsers.items():
        rows = parse(chosen.where(F.col("_parser") == suffix).drop("_parser"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    try:
        return json.loads(text)
    except ValueError:
        return None if text in ("", "~") else text


def settings(text: str) -> dict:
    """A small settings file: JSON, or lines of `name: value`, where a name without value opens a list of `- value` lines
    or an indented group of names. Comments start with #."""
    if text.lstrip().startswith(("{", "[")):
        return json.loads(text)
    out: dict = {}
    group: dict | list | None = None
    name = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        inside = line[0] in " \t"
        if line.lstrip().startswith("- "):
            if name is None:
                raise ValueError(f"a list without a name: {raw}")
            group = group if isinstance(group, list) else []
            group.append(_scalar(line.lstrip()[2:]))
            out[name] = group
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"neither name nor value: {raw}")
        if inside and name is not None:
            group = group if isinstance(group, dict) else {}
            group[_scalar(key)] = _scalar(value)
            out[name] = group
        else:
            name, group = str(_scalar(key)), None
            out[name] = _scalar(value)
    return out


def budgets(text: str) -> dict[str, float]:
    """Category limits of a budget file, in a group `budget` or by themselves; other things than numbers are an error."""
    found = settings(text)
    found = found.get("budget", found)
    wrong = [k for k, v in found.items() if isinstance(v, bool) or not isinstance(v, (int, float))]
    if wrong:
        raise ValueError(f"no number for {', '.join(wrong)}")
    return {k: float(v) for k, v in found.items()}


def variables(text: str) -> dict[str, str]:
    """NAME=value lines; `export` and quotes are taken off, comments and other lines left out."""
    found = re.findall(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(\"[^\"\n]*\"|'[^'\n]*'|[^#\n]*)", text, re.M)
    return {k: v.strip()[1:-1] if v.strip()[:1] in "\"'" and len(v.strip()) > 1 else v.strip() for k, v in found}


def moment(text: str, now: datetime) -> datetime:
    """A time as people write it: 7d, 24h, 2w or 30m before now, or an ISO date or time; without a zone it is UTC."""
    if m := re.fullmatch(r"\s*(\d+)\s*([mhdw])\s*", text):
        return now - int(m[1]) * {"m": timedelta(minutes=1), "h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}[m[2]]
    found = datetime.fromisoformat(text.strip())
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def since(rows: DataFrame, column: str, start: datetime | None, key: str) -> DataFrame:
    """rows from a time on, a literal that reaches the scan, in order of time and key; all rows where it is None."""
    return (rows if start is None else rows.where(F.col(column) >= F.lit(start))).orderBy(column, key)


def event_stream(lines: DataFrame, terminal: tuple[str, ...] = ("run.completed", "run.failed", "run.cancelled")) -> DataFrame:
    """run, tools, status of server-sent events: `data:` lines (run, n, line) of JSON that names its event (or type), up to the first
    terminal one; tools counts tool.started, status is the terminal type or null."""
    body = F.regexp_extract("line", r"^data:\s?(.*)$", 1)
    rows = lines.where(F.startswith("line", F.lit("data:"))).select("run", "n", F.coalesce(F.get_json_object(body, "$.event"), F.get_json_object(body, "$.type")).alias("type"))
    ends = rows.where(F.col("type").isin(*terminal)).groupBy("run").agg(F.min(F.struct("n", "type")).alias("end"))
    own = rows.join(ends, "run", "left").where(F.col("end.n").isNull() | (F.col("n") <= F.col("end.n")))
    return own.groupBy("run").agg(F.count_if(F.col("type") == "tool.started").alias("tools"), F.max("end.type").alias("status"))
