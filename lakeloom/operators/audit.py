"""Audit reports of a table: who it is, how its schema and snapshots came about; JSON, Markdown, PDF."""

from __future__ import annotations

import datetime as dt
import json
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from ..table import Table


def _time(ms: int) -> str:
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).isoformat(timespec="milliseconds")


def report(table: Table) -> dict:
    """Everything the report says, as plain values."""
    m = table.metadata
    return {
        "table": str(table.identifier or table.location),
        "uuid": m.table_uuid,
        "location": m.location,
        "last_updated": _time(m.last_updated_ms),
        "last_sequence_number": m.last_sequence,
        "current_snapshot_id": m.current_snapshot_id,
        "metrics": m.metrics,
        "properties": m.properties,
        "schemas": [{"schema_id": s.schema_id, "current": s.schema_id == m.current_schema_id, "fields": [{"id": f.id, "name": n, "type": f.type["type"], "required": f.required} for n, f in s.all_fields()]} for s in m.schemas],
        "snapshots": [{"snapshot_id": s.snapshot_id, "parent_id": s.parent_id, "sequence": s.sequence, "made_at": _time(s.timestamp_ms), "operation": s.operation, "schema_id": s.schema_id, "summary": s.summary} for s in m.snapshots],
        "log": [{"snapshot_id": i, "made_at": _time(t), "operation": o} for i, t, o in m.snapshot_log],
    }


def to_json(table: Table) -> str:
    return json.dumps(report(table), indent=2, sort_keys=True)


def to_markdown(table: Table) -> str:
    r = report(table)
    lines = [f"# Audit of {r['table']}", "", f"- uuid: `{r['uuid']}`", f"- location: `{r['location']}`", f"- last updated: {r['last_updated']}", f"- current snapshot: {r['current_snapshot_id']}"]
    lines += [f"- {k}: {v}" for k, v in r["metrics"].items()] + [f"- property `{k}`: {v}" for k, v in sorted(r["properties"].items())]
    for s in r["schemas"]:
        lines += ["", f"## Schema {s['schema_id']}" + " (current)" * s["current"], "", "| id | name | type | required |", "| --- | --- | --- | --- |"]
        lines += [f"| {f['id']} | {f['name']} | {f['type']} | {'yes' if f['required'] else 'no'} |" for f in s["fields"]]
    lines += ["", "## Snapshots", "", "| id | parent | made at | operation | added | removed | total |", "| --- | --- | --- | --- | --- | --- | --- |"]
    for s in r["snapshots"]:
        v = s["summary"]
        lines.append(f"| {s['snapshot_id']} | {s['parent_id'] or ''} | {s['made_at']} | {s['operation']} | {v.get('added-records', 0)} | {v.get('deleted-records', 0)} | {v.get('total-records', 0)} |")
    lines += ["", "## Log", ""] + [f"- {x['made_at']}: snapshot {x['snapshot_id']} by {x['operation']}" for x in r["log"]]
    return "\n".join(lines) + "\n"


def to_pdf(table: Table) -> bytes:
    """The Markdown text on plain PDF pages, in a font that every reader has."""
    lines = [line[i : i + 95] for line in to_markdown(table).splitlines() for i in range(0, max(1, len(line)), 95)]
    pages = [lines[i : i + 60] for i in range(0, len(lines), 60)]
    escape = lambda s: s.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for i, page in enumerate(pages):
        text = b"BT /F1 9 Tf 40 800 Td 12 TL\n" + b"".join(b"(" + escape(line) + b") Tj T*\n" for line in page) + b"ET"
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d >>\nstream\n" % len(text) + text + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    table_at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table_at)
