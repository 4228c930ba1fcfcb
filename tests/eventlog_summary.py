"""Summarize a Spark event log: per stage, task count and task-time skew.

Usage: python tests/eventlog_summary.py <event log file> [top N]
Prints the stages with the largest total task time, with median and max
task durations (a max far above the median flags a skewed partition).
"""

from __future__ import annotations

import io
import json
import os
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    """Event lines of a log file or of a rolling log folder (zstd or plain)."""
    files = ([os.path.join(path, f) for f in sorted(os.listdir(path),
                                                     key=lambda f: int(f.split("_")[1]) if f.startswith("events_") else -1)
              if f.startswith("events_")] if os.path.isdir(path) else [path])
    for fp in files:
        if fp.endswith(".zstd"):
            import zstandard
            with open(fp, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                yield from text
        else:
            with open(fp, encoding="utf-8") as f:
                yield from f


def summarize(path: str, top: int = 15) -> list[dict]:
    tasks: dict[tuple, list[float]] = defaultdict(list)
    names: dict[tuple, str] = {}
    stage_job: dict[int, str] = {}
    for line in _lines(path):
        if line.strip():
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (ev.get("Properties") or {}).get("spark.job.description", "")
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = desc
            if kind == "SparkListenerTaskEnd":
                info = ev["Task Info"]
                key = (ev["Stage ID"], ev["Stage Attempt ID"])
                tasks[key].append((info["Finish Time"] - info["Launch Time"]) / 1000.0)
            elif kind == "SparkListenerStageCompleted":
                st = ev["Stage Info"]
                names[(st["Stage ID"], st["Stage Attempt ID"])] = st["Stage Name"]
    rows = []
    for key, ds in tasks.items():
        rows.append({"stage": key[0], "query": stage_job.get(key[0], ""),
                     "name": names.get(key, "")[:60], "tasks": len(ds),
                     "total_s": round(sum(ds), 3), "median_s": round(statistics.median(ds), 3),
                     "max_s": round(max(ds), 3)})
    return sorted(rows, key=lambda r: -r["total_s"])[:top]


if __name__ == "__main__":
    for r in summarize(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15):
        print(r)
