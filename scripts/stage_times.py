"""Summarise a Spark event log: per stage, task count and time spread.

Usage: python scripts/stage_times.py EVENT_LOG_FILE_OR_FOLDER [min_tasks]
Prints one line per stage with at least ``min_tasks`` tasks (default 2):
tasks, median and max task time (ms), max/median ratio (skew), and shuffle
read/write bytes.  The UI stays off; this reads the log file only.
"""

from __future__ import annotations

import io
import json
import os
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    """Lines of an event log: one file, or a rolling-log folder (Spark 4)."""
    files = ([os.path.join(path, f) for f in sorted(os.listdir(path), key=_part_no)
              if f.startswith("events_")] if os.path.isdir(path) else [path])
    for name in files:
        if name.endswith(".zstd"):
            import zstandard
            with open(name, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(name, encoding="utf-8") as f:
                yield from f


def _part_no(name: str) -> int:
    parts = name.split("_")
    return int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 0


def main(argv) -> None:
    path = argv[1]
    min_tasks = int(argv[2]) if len(argv) > 2 else 2
    tasks = defaultdict(list)
    names = {}
    shuffle = defaultdict(lambda: [0, 0])
    for line in _lines(path):
        if True:
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerStageSubmitted":
                info = ev["Stage Info"]
                names[(info["Stage ID"], info["Stage Attempt ID"])] = info["Stage Name"]
            elif kind == "SparkListenerTaskEnd" and ev.get("Task Info"):
                key = (ev["Stage ID"], ev["Stage Attempt ID"])
                ti = ev["Task Info"]
                tasks[key].append(ti["Finish Time"] - ti["Launch Time"])
                m = ev.get("Task Metrics") or {}
                shuffle[key][0] += (m.get("Shuffle Read Metrics") or {}).get("Remote Bytes Read", 0) \
                    + (m.get("Shuffle Read Metrics") or {}).get("Local Bytes Read", 0)
                shuffle[key][1] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    print("stage  tasks  median_ms  max_ms  max/median  shuffle_read  shuffle_write  name")
    for key in sorted(tasks):
        ds = tasks[key]
        if len(ds) < min_tasks:
            continue
        med = statistics.median(ds)
        print(f"{key[0]:>5} {len(ds):>6} {med:>10.0f} {max(ds):>7} {max(ds) / max(med, 1):>11.2f} "
              f"{shuffle[key][0]:>13} {shuffle[key][1]:>14}  {names.get(key, '')[:40]}")


if __name__ == "__main__":
    main(sys.argv)
