"""WFDB records (.hea with .dat, formats 16 and 212) as a DataFrame, after the public description of the formats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC = "record string, fs double, n_samples long, place int, lead string, units string, file string, format int, gain double, baseline int, channel int, channels int"


def parse_header(text: str) -> list[dict]:
    """A signal per row: its file, format, gain and baseline, and which of the file's interleaved channels it is."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head = lines[0].split()
    if "/" in head[0]:
        raise ValueError("records of several segments are not supported")
    rate = float(re.match(r"[\d.]+", head[2]).group()) if len(head) > 2 else 250.0
    out = []
    for place, line in enumerate(lines[1 : 1 + int(head[1])]):
        part = line.split(None, 8)
        gain = re.match(r"([-+\d.eE]+)?(?:\((-?\d+)\))?(?:/(\S+))?", part[2] if len(part) > 2 else "")
        zero = int(part[4]) if len(part) > 4 else 0
        out.append({
            "record": head[0], "fs": rate, "n_samples": int(head[3]) if len(head) > 3 else None, "place": place, "lead": part[8] if len(part) > 8 else f"lead{place}", "units": gain[3] or "mV",
            "file": part[0], "format": int(re.match(r"\d+", part[1]).group()), "gain": float(gain[1] or 0) or 200.0, "baseline": int(gain[2]) if gain[2] else zero,
        })
    for s in out:
        own = [x["place"] for x in out if x["file"] == s["file"]]
        s["channel"], s["channels"] = own.index(s["place"]), len(own)
    return out


def decode(data: bytes, fmt: int) -> np.ndarray:
    """Stored values; those that mark a missing sample are NaN."""
    if fmt == 16:
        raw = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype("f8")
        raw[raw == -32768] = np.nan
        return raw
    if fmt == 212:
        b = np.frombuffer(data + b"\0" * (-len(data) % 3), "u1").astype("i4").reshape(-1, 3)
        raw = np.stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4], 1).ravel()[: len(data) * 2 // 3].astype("f8")
        raw[raw > 2047] -= 4096
        raw[raw == -2048] = np.nan
        return raw
    raise ValueError(f"format {fmt} is not supported")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Signals and rejects of all records under path. Signals: path (of the header, without .hea), record, fs, place, lead, units, values.

    Headers and signal files are scanned apart and meet on their folder and file name; a record that does not parse is a
    reject (path, error), the others go on. A missing sample is null.
    """
    def files(suffix: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(path)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [x | {"path": name[:-4], "error": None} for x in parse_header(content.decode())]
                except (ValueError, IndexError, AttributeError) as e:
                    rows.append({"path": name[:-4], "error": f"header: {e}"})
            columns = [x.split()[0] for x in SPEC.split(", ")] + ["path", "error"]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("n_samples", "place", "format", "baseline", "channel", "channels")})

    def signals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, errors = [], []
            for s in batch.itertuples():
                try:
                    if s.content is None:
                        raise ValueError("no signal file")
                    raw = decode(s.content, int(s.format))[int(s.channel) :: int(s.channels)]
                    values.append(((raw if pd.isna(s.n_samples) else raw[: int(s.n_samples)]) - s.baseline) / s.gain)
                    errors.append(None)
                except ValueError as e:
                    values.append(None)
                    errors.append(str(e))
            yield batch[["path", "record", "fs", "place", "lead", "units"]].assign(values=values, error=errors)

    found = files("*.hea").select("path", "content").mapInPandas(headers, SPEC + ", path string, error string")
    wanted = found.where("error IS NULL").withColumn("at", F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("file"))).drop("error")
    data = files("*.dat").select(F.col("path").alias("at"), "content")
    decoded = wanted.join(data, "at", "left").mapInPandas(signals, "path string, record string, fs double, place int, lead string, units string, values array<double>, error string")
    rejects = found.where("error IS NOT NULL").select("path", "error").union(decoded.where("error IS NOT NULL").select("path", "error")).distinct()
    return decoded.where("error IS NULL").drop("error"), rejects
