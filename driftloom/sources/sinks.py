"""Where results go: files that appear whole or not at all, the browsable tree, manifest, report and summary."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame


def write_atomic(path: str, data: bytes) -> None:
    """Write beside the target, flush to disk, rename."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_json(path: str, value: object) -> None:
    write_atomic(path, (json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n").encode())


def write_tree(files: DataFrame, root: str) -> int:
    """(path, content) to files below root, a folder that all executors share; paths that leave it are refused. Returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                full = os.path.normpath(os.path.join(root, path))
                if full.startswith(os.path.normpath(root) + os.sep):
                    write_atomic(full, content.encode() if isinstance(content, str) else content)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def entry_json(r: dict) -> dict:
    return {"url": r["url"], "path": r["path"], "status": r["status"], "kind": r["kind"], "contentType": r["content_type"], "sha256": r["sha256"], "sizeBytes": r["size_bytes"], "fetcher": r["fetcher"], **({"error": r["error"]} if r["error"] else {})}


def _streamed(path: str, head: dict, field: str, items: Iterator[str], ends: str) -> None:
    """One JSON object whose last field is written as its items come, then renamed to its place."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(json.dumps(head, indent=2, ensure_ascii=False, default=str).rstrip("}\n") + f',\n  "{field}": {ends[0]}')
            for k, item in enumerate(items):
                f.write((",\n    " if k else "\n    ") + item)
            f.write(f"\n  {ends[1]}\n}}\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_manifest(path: str, manifest: DataFrame, seed: str, scope_root: str) -> None:
    """The JSON form, for other tools; the table is what later runs read. Rows pass the driver one partition at a time and aren't kept."""
    rows = manifest.orderBy("seq").toLocalIterator()
    items = (f"{json.dumps(r['url'], ensure_ascii=False)}: {json.dumps(entry_json(r), ensure_ascii=False)}" for r in rows)
    _streamed(path, {"seed": seed, "scopeRoot": scope_root, "updatedAt": datetime.now(UTC).isoformat()}, "entries", items, "{}")


def write_report(path: str, counts: dict, failures: DataFrame, seed: str, scope_root: str, interrupted: bool) -> None:
    """The report with every failure, one partition of them at a time."""
    items = (json.dumps({"url": r["url"], "status": r["category"], "error": r["reason"]}, ensure_ascii=False) for r in failures.toLocalIterator())
    head = report_json(counts, [], seed, scope_root, interrupted)
    head.pop("failures")  # the number of them; the list takes its name
    _streamed(path, head, "failures", items, "[]")


def report_json(counts: dict, failures: list[dict], seed: str, scope_root: str, interrupted: bool) -> dict:
    return {"seed": seed, "scopeRoot": scope_root, "finishedAt": datetime.now(UTC).isoformat(), "interrupted": interrupted, **counts, "failures": failures}


def summary(counts: dict) -> str:
    lines = [f"pages: {counts['pages']}", f"assets: {counts['assets']}", f"size: {counts['bytes'] / (1 << 20):.1f} MB"]
    lines += [f"{k}: {counts[k]}" for k in ("robots_skipped", "excluded", "failures") if counts.get(k)]
    return "\n".join(lines)
