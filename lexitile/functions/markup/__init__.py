"""Markup scanners: each turns a text into ``(kind, content)`` segments whose contents join to the text again."""

from __future__ import annotations

from lexitile.functions.markup.code import segment_code
from lexitile.functions.markup.latex import chunk_latex, segment_latex
from lexitile.functions.markup.myst import chunk_myst, segment_myst
from lexitile.functions.markup.typst import chunk_typst, segment_typst

Segments = list[tuple[str, str]]


def checked(text: str | None, kind: str, **options) -> tuple[Segments, bool]:
    """Segments by chunk type, and whether the scanner gave the text back whole; unknown types, and a text it did not give back, are one placeholder.

    NULL and '' have no segments.
    """
    if not text:
        return [], True
    scan = {"latex": segment_latex, "myst": segment_myst, "typst": segment_typst, "python": segment_code, "java": segment_code, "rust": segment_code}.get(kind)
    if scan is None:
        return [("placeholder", text)], True
    found = [(k, c) for k, c in (scan(text, kind) if scan is segment_code else scan(text, **options)) if c]
    whole = "".join(c for _, c in found) == text
    return found if whole else [("placeholder", text)], whole


def segment(text: str | None, kind: str, **options) -> Segments:
    """The segments of ``checked``."""
    return checked(text, kind, **options)[0]


def chunk(text: str | None, kind: str) -> list[dict]:
    """``kind, content`` chunks of a document by type; NULL and blank documents have none."""
    if not text or not text.strip():
        return []
    return {"latex": chunk_latex, "myst": chunk_myst, "markdown": chunk_myst, "typst": chunk_typst}[kind](text)
