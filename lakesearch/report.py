"""Texts for people: sizes, durations, progress, the status of all bases."""

from __future__ import annotations

import math


def size(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    for unit, digits in (("KB", 1), ("MB", 1)):
        n /= 1024
        if n < 1024:
            return f"{n:.{digits}f} {unit}"
    return f"{n / 1024:.2f} GB"


def duration(ms: float) -> str:
    """Whole seconds, rounded up; minutes from sixty on."""
    if not math.isfinite(ms) or ms <= 0:
        return "0s"
    minutes, seconds = divmod(math.ceil(ms / 1000), 60)
    return " ".join(([f"{minutes}m"] if minutes else []) + ([f"{seconds}s"] if seconds or not minutes else []))


def progress(chunks: int, elapsed_ms: float, files: int | None = None, total: int | None = None, skipped: int = 0) -> str:
    """Rates are over a second at least; the time left follows from the files so far."""
    s = max(1, elapsed_ms / 1000)
    out = f"{chunks} chunks, {chunks / s:.1f} chunks/s, elapsed {duration(elapsed_ms)}"
    if files is not None and total:
        left = max(0, total - files) * s / files * 1000 if files else 0
        out = f"{files}/{total} files, {out}, file ETA {duration(left)}"
    elif files is not None:
        out = f"{files} files scanned, {out}"
    return out + (f", skipped {skipped}" if skipped else "")


def available(kbs: list[dict]) -> str | None:
    if not kbs:
        return None
    return "Knowledge bases: " + ", ".join(f"{k['name']} ({k['chunk_count']} chunks, {k['file_count']} files)" for k in kbs) + ". Search them before answering questions about their subjects."


def status(root: str, kbs: list[dict], diagnosed: list[dict], now: int, watchers: int = 0) -> str:
    found = {d["kb_id"]: d for d in diagnosed}
    lines = [f"Storage: {root}", f"Knowledge bases: {len(kbs)}", f"Watchers: {watchers}"]
    for k in kbs:
        lines.append(f"{k['name']}: {k['status']}, {k['chunk_count']} chunks, {k['file_count']} files, updated {duration(now - k['updated_at'])} ago")
        if k["source_path"]:
            lines.append(f"  source: {k['source_path']}")
        if d := found.get(k["id"]):
            if d["job_status"]:
                lines.append(f"  job: {d['job_status']} ({d['phase']}), last progress {duration(now - (d['last_progress_at'] or now))} ago")
            lines.append(f"  coverage: {d['coverage_percent']}% ({d['indexed']}/{d['current']} files)")
            lines += [f"  {what}: {d[what]} files" for what in ("stale", "orphans", "skipped") if d[what]]
            if d["stuck"]:
                lines.append("  indexing appears stuck")
    stale, orphans, stuck = (sum(d[x] for d in diagnosed) for x in ("stale", "orphans", "stuck"))
    if stale or orphans or stuck:
        lines.append(f"Health: {stale} stale, {orphans} orphans, {stuck} stuck")
    elif kbs:
        lines.append("Health: all indexes are up to date")
    return "\n".join(lines)
