"""Texts, addresses and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Line feeds only, no white space at line ends, at most one empty line in a row, none at the ends."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit("\n"))


def content_hash(text: Column, version: str = "1") -> Column:
    return F.sha2(F.concat(F.lit(version + "\n"), F.coalesce(text, F.lit(""))), 256)


def token_estimate(text: Column, chars: float = 4.0) -> Column:
    return F.ceil(F.length(text) / F.lit(chars)).cast("long")


def snippet(text: Column, size: int = 280) -> Column:
    """The text's start, cut at a word's edge."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.regexp_extract(F.substring(flat, 1, size + 1), r"^(.*)\s", 1))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def srt_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("1L") * F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def route(url: Column) -> Column:
    """The path of an address: without host, query and fragment, segments that are numbers as {id}."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.regexp_replace(path, r"(?<=/)[0-9]+(?=/|$)", "{id}")


def breadcrumb(title: Column, headings: Column, text: Column) -> Column:
    """What is embedded for a chunk: where it stands, then its text."""
    path = F.array_join(F.concat(F.array(title), headings), " > ")
    return F.concat_ws("\n\n", F.when(path != "", path), text)


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def event_type(payload: Column) -> Column:
    """A webhook's type: its `event`, else its `type`, else unknown."""
    found = [F.nullif(F.get_json_object(payload, p), F.lit("")) for p in ("$.event", "$.type")]
    return F.coalesce(*found, F.lit("unknown"))


def media_kind(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(extension.isin("mp3", "wav", "m4a", "ogg", "flac", "opus"), "audio").when(extension.isin("mp4", "mkv", "mov", "webm", "avi"), "video").otherwise("other")


def answer_numbers(text: Column) -> Column:
    """Thousands marks taken out and decimal commas made points, so that answers in either writing compare."""
    out = F.regexp_replace(text, r"(?<=[0-9])\.(?=[0-9]{3}(?:[.,]|\b))(?![0-9]{3}[0-9])", "")
    return F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9]{1,2}\b)", ".")


# The common commands that run tests, and how an output names its exit code.
TEST_COMMANDS = [
    "go test", "pytest", "uv run pytest", "npm (run )?test", "pnpm (run )?test", "yarn test", "cargo test", "make (test|check)",
    "vitest", "jest", "python3? -m (pytest|unittest)",
]
EXIT_CODE = r"(?i)(?:exit[_ ]code|exit status|Exit code)[\"':= ]+(-?\d+)"


def is_test_command(command: Column, own: tuple[str, ...] = ()) -> Column:
    """Does a shell command run a project's tests? own: patterns of a platform's own checkers, which count as well."""
    return F.coalesce(command, F.lit("")).rlike(rf"\b({'|'.join([*TEST_COMMANDS, *own])})\b")


def exit_code(output: Column) -> Column:
    """The exit code of a tool's output: of a JSON object its exit_code, or returncode where that field is missing, 0 if
    it is null or empty; of other text, and of objects whose field isn't a number, the first code that is named, else 0."""
    keys = F.json_object_keys(output)
    field = F.when(F.array_contains(keys, "exit_code"), F.get_json_object(output, "$.exit_code")).otherwise(F.get_json_object(output, "$.returncode"))
    told = F.when(field.isNull() | field.isin("", "null", "false"), F.lit("0")).when(field == "true", F.lit("1")).otherwise(field)
    named = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(output, F.lit("")), EXIT_CODE, 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.coalesce(F.when(keys.isNotNull(), told.try_cast("double").try_cast("int")), named)


def is_slug(text: Column) -> Column:
    """Lower-case letters and digits in parts joined by single hyphens, 64 characters at most."""
    return F.coalesce(text.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length(text) <= 64), F.lit(False))


def is_repository(text: Column) -> Column:
    """owner/name as code hosts write it."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]{1,100}$"), F.lit(False))


def is_uri(text: Column) -> Column:
    """A scheme, :// and a path without white space or steps upwards."""
    return F.coalesce(text.rlike(r"^[a-z][a-z0-9+.-]*://[^\s]+$") & ~text.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def listed(fields: list[Column], most: int = 10) -> Column:
    """The first of several arrays of texts that isn't null or empty: trimmed, without blanks and repeats, `most` at most."""
    clean = [F.array_distinct(F.filter(F.transform(f, lambda x: F.trim(x)), lambda x: x != "")) for f in fields]
    return F.slice(F.coalesce(*[F.when(F.size(c) > 0, c) for c in clean], F.array().cast("array<string>")), 1, most)
