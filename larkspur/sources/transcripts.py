"""Subtitles, transcription results, recordings and logs as rows."""

from __future__ import annotations

import io
import re
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})")
SEGMENT = "array<struct<start:double,end:double,text:string>>"


def seconds(stamp: str) -> float:
    h, m, s, ms = TIME.match(stamp.strip()).groups()
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + int(ms.ljust(3, "0")) / 1000


def cues(text: str | None) -> list[dict]:
    """Cues of SRT or VTT text: tags, notes and styles left out, a text equal to the one before only once."""
    out: list[dict] = []
    for block in re.split(r"\n\s*\n", (text or "").replace("\r\n", "\n").lstrip("\ufeff")):
        lines = [x for x in block.split("\n") if x.strip()]
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is None or lines[0].startswith(("NOTE", "STYLE", "REGION")):
            continue
        start, end = lines[at].split("-->")
        said = " ".join(re.sub(r"<[^>]*>|\{[^}]*\}", "", x).strip() for x in lines[at + 1 :]).strip()
        if said and not (out and out[-1]["text"] == said):
            out.append({"start": seconds(start), "end": max(seconds(start), seconds(end.split()[0])), "text": said})
    return out


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, place, start, end, text of all cues."""

    @F.pandas_udf(SEGMENT)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(cues)

    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return files.select("path", F.posexplode(parse("value")).alias("place", "c")).select("path", "place", "c.*")


def segments(results: DataFrame, json: str = "json") -> DataFrame:
    """Segments of transcription results: blank ones left out, an end not before its start, a whole text as one segment."""
    schema = "text string, duration double, segments array<struct<start:double,end:double,text:string>>"
    r = F.from_json(json, schema)
    named = F.filter(F.transform(F.coalesce(r["segments"], F.array().cast(SEGMENT)), lambda s: F.struct(s["start"].alias("start"), F.greatest(s["start"], s["end"]).alias("end"), F.trim(s["text"]).alias("text"))), lambda s: s["text"] != "")
    whole = F.filter(F.array(F.struct(F.lit(0.0).alias("start"), F.coalesce(r["duration"], F.lit(0.0)).alias("end"), F.trim(r["text"]).alias("text"))), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    others = [c for c in results.columns if c != json]
    return results.select(*others, F.posexplode(F.when(F.size(named) > 0, named).otherwise(whole)).alias("place", "s")).select(*others, "place", "s.*")


def shifted(rows: DataFrame, offset: str) -> DataFrame:
    """Segments moved by their part's offset."""
    return rows.withColumns({c: F.col(c) + F.col(offset) for c in ("start", "end")})


def rendered(rows: DataFrame, key: str) -> DataFrame:
    """key, srt: the segments (place, start, end, text) of each key as SRT text; a transcript is one text by nature."""
    from larkspur.functions.texts import srt_time

    cue = F.concat_ws("\n", (F.col("place") + 1).cast("string"), F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end"))), "text")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("srt"))


def quietest(samples: np.ndarray, rate: int, around: float, within: float = 5.0, window: float = 0.2) -> float:
    """The middle, in seconds, of the quietest window near a place."""
    first, last = max(0, int((around - within) * rate)), min(len(samples), int((around + within) * rate))
    size = max(1, int(window * rate))
    if last - first <= size:
        return around
    energy = np.cumsum(np.concatenate(([0.0], samples[first:last].astype(np.float64) ** 2)))
    return (first + int(np.argmin(energy[size:] - energy[:-size])) + size / 2) / rate


def read_recordings(spark: SparkSession, path: str, part_seconds: float = 600.0) -> DataFrame:
    """path, rate, seconds, cuts: WAV files with the quiet places at which they may be cut into parts."""

    def probe(batches):
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(bytes(data))) as w:
                    rate, n, channels = w.getframerate(), w.getnframes(), w.getnchannels()
                    samples = np.frombuffer(w.readframes(n), dtype=np.int16)[::channels]
                cuts = [quietest(samples, rate, t) for t in np.arange(part_seconds, n / rate, part_seconds)]
                rows.append((p, rate, n / rate, cuts))
            yield pd.DataFrame(rows, columns=["path", "rate", "seconds", "cuts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(probe, "path string, rate int, seconds double, cuts array<double>")


def read_gateway_log(spark: SparkSession, path: str) -> DataFrame:
    """level, method, path, status, dur, req_id of key=value log lines; lines without a status are left out."""
    part = lambda k: F.regexp_extract("value", rf"(?:^|\s){k}=\"?([^\s\"]*)", 1)
    rows = spark.read.text(path).select(*[part(k).alias(k) for k in ("level", "method", "path", "status", "dur", "req_id")])
    return rows.withColumn("status", F.col("status").try_cast("int")).where("status IS NOT NULL")


def server_errors(log: DataFrame) -> DataFrame:
    """How often each route failed with a status from 500 to 599."""
    from larkspur.functions.texts import route

    return log.where(F.col("status").between(500, 599)).groupBy(route(F.col("path")).alias("route")).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "route")
