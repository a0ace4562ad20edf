"""Results as text for people."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

PREVIEW = 160


#: What of an item's metadata is shown.
PUBLIC = ("source", "file_id", "collection_id", "file_name", "file_type", "page_start", "page_end", "chunk_index")


def public(value: Any) -> Any:
    """A result as it is shown: without evidence of retrieval, and with public metadata only, at every depth."""
    if isinstance(value, Mapping):
        shown = {k: public(v) for k, v in value.items() if k != "retrieval"}
        if isinstance(shown.get("metadata"), Mapping):
            shown["metadata"] = {k: v for k, v in shown["metadata"].items() if k in PUBLIC}
        return shown
    return [public(v) for v in value] if isinstance(value, list | tuple) else value


def score(value: float | None) -> str:
    return "n/a" if value is None else f"{value:.3f}"


def page(row: Mapping[str, Any]) -> str:
    a, b = row.get("page_start"), row.get("page_end")
    if a is None or b is None:
        return "n/a"
    return str(a) if a == b else f"{a}-{b}"


def preview(text: str, limit: int | None = PREVIEW) -> str:
    return text if limit is None or len(text) <= limit else f"{text[:limit].rstrip()}..."


def results(query: str, rows: Sequence[Mapping[str, Any]], limit: int | None = PREVIEW) -> str:
    """A query's results, numbered, with source, pages, score and the beginning of the content."""
    out = [f"Query: {query}", f"Results: {len(rows)}"]
    for i, r in enumerate(rows, 1):
        out += ["", f"{i}. {r.get('source') or 'n/a'}, page {page(r)}, score {score(r.get('score'))}", preview(r["content"], limit)]
    return "\n".join(out)


def answer(said: Mapping[str, Any]) -> str:
    """An answer with its confidence and sources, and the reason if it is a fallback."""
    out = [f"Query: {said['query']}", f"Confidence: {said['confidence']}", "", said["answer"]]
    if said.get("fallback_reason"):
        out += ["", f"Fallback: {said['fallback_reason']}"]
    out += ["", f"Sources: {len(said['sources'])}"]
    return "\n".join([*out, *(f"- {s['source']}, page {s['page_label']}, score {score(s['score'])}" for s in said["sources"])])


def records(rows: Sequence[Mapping[str, Any]]) -> str:
    """Rows of the catalog, one a line."""
    return "\n".join("  ".join(f"{k}={'' if v is None else v}" for k, v in r.items()) for r in rows) or "none"
