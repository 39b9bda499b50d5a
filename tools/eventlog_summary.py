"""Summarise a Spark event log: per job group (bench query) the number of
jobs and stages, total stage time, task count, and shuffle read/write.

usage: python tools/eventlog_summary.py <event log dir or file> [top_stages]
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _files(path: str) -> list[str]:
    """Event-log files under ``path`` (plain or rolling v2 directories)."""
    if os.path.isfile(path):
        return [path]
    out = []
    for root, _, names in os.walk(path):
        out += [os.path.join(root, n) for n in names
                if n.startswith(("events", "local-", "app-")) and not n.endswith(".inprogress.crc")]
    return sorted(out)


def _lines(f: str):
    if f.endswith(".zstd"):
        import io

        import zstandard
        with open(f, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(f, encoding="utf-8") as fh:
            yield from fh


def summarise(path: str, top: int = 10) -> None:
    job_group: dict[int, str] = {}
    stage_job: dict[int, int] = {}
    groups = defaultdict(lambda: {"jobs": 0, "stages": 0, "ms": 0, "tasks": 0, "shuffle_read": 0, "shuffle_write": 0})
    stages = []
    for f in _files(path):
        for line in _lines(f):
            if True:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    props = ev.get("Properties") or {}
                    g = props.get("spark.jobGroup.id", "-")
                    job_group[ev["Job ID"]] = g
                    groups[g]["jobs"] += 1
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = ev["Job ID"]
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    sid = info["Stage ID"]
                    g = job_group.get(stage_job.get(sid, -1), "-")
                    ms = (info.get("Completion Time") or 0) - (info.get("Submission Time") or 0)
                    acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
                    sr = int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0) + \
                        int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0)
                    sw = int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0)
                    rec = groups[g]
                    rec["stages"] += 1
                    rec["ms"] += ms
                    rec["tasks"] += info.get("Number of Tasks", 0)
                    rec["shuffle_read"] += sr
                    rec["shuffle_write"] += sw
                    stages.append((ms, g, sid, info.get("Stage Name", "")[:60], info.get("Number of Tasks", 0)))
    print(f"{'group':30s} {'jobs':>5s} {'stages':>6s} {'stage_ms':>9s} {'tasks':>6s} {'shuf_rd_MB':>10s} {'shuf_wr_MB':>10s}")
    for g, r in sorted(groups.items(), key=lambda kv: -kv[1]["ms"]):
        print(f"{g[:30]:30s} {r['jobs']:5d} {r['stages']:6d} {r['ms']:9d} {r['tasks']:6d} "
              f"{r['shuffle_read'] / 1e6:10.2f} {r['shuffle_write'] / 1e6:10.2f}")
    print(f"\nslowest {top} stages:")
    for ms, g, sid, name, tasks in sorted(stages, reverse=True)[:top]:
        print(f"  {ms:7d} ms  stage {sid:4d}  tasks {tasks:4d}  {g[:28]:28s} {name}")


if __name__ == "__main__":
    summarise(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 10)
