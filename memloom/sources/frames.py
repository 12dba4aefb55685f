"""Frames of videos, through a media program on the executors; nothing here runs unless that program is installed."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROGRAMS = ("ffmpeg", "ffprobe")
SECONDS = 30


def available() -> bool:
    return all(shutil.which(p) for p in PROGRAMS)


def run_program(args: list[str]) -> subprocess.CompletedProcess:
    """Only the media programs, never a path that looks like an option."""
    if os.path.basename(args[0]) not in PROGRAMS:
        raise ValueError(f"{args[0]!r} isn't allowed")
    return subprocess.run(args, capture_output=True, timeout=SECONDS, check=True)


def safe_path(path: str) -> str:
    if not path or path.startswith("-"):
        raise ValueError("paths must not start with a dash")
    return path


def frame_times(duration: float, n: int) -> list[float]:
    """n times that cut the duration into n + 1 equal parts."""
    return [duration * (i + 1) / (n + 1) for i in range(n)]


def _frames(path: str, n: int) -> list[tuple[float, bytes]]:
    said = run_program(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "json", safe_path(path)])
    out = []
    for at in frame_times(float(json.loads(said.stdout)["format"]["duration"]), n):
        with tempfile.NamedTemporaryFile(suffix=".jpg") as f:
            run_program(["ffmpeg", "-y", "-ss", f"{at:.3f}", "-i", safe_path(path), "-frames:v", "1", f.name])
            out.append((at, f.read()))
    return out


def frames(videos: DataFrame, n: int = 1, url: str = "url", content: str = "content") -> DataFrame:
    """(url, at, frame, error): n evenly spaced frames of every video, the middle one for n = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for u, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with tempfile.NamedTemporaryFile(suffix=os.path.splitext(u)[1]) as f:
                        f.write(c)
                        f.flush()
                        rows += [(u, at, frame, None) for at, frame in _frames(f.name, n)]
                except Exception as e:
                    rows.append((u, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.binary(), pa.string()), strict=True)], ["url", "at", "frame", "error"])

    return videos.select(F.col(url).alias("url"), F.col(content).alias("content")).mapInArrow(run, "url string, at double, frame binary, error string")
