"""Translation units: one <TEXT> element in which protected stretches are numbered <PH> elements."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

Segments = list[tuple[str, str]]


def coalesce(segments: Segments) -> Segments:
    """Neighbouring placeholders merged, a bare line end stays alone; math counts as placeholder, neighbouring text is joined."""
    out: Segments = []
    for kind, content in segments:
        if not content:
            continue
        kind = "text" if kind == "text" else "placeholder"
        bare = kind == "placeholder" and content == "\n"
        if out and out[-1][0] == kind and not bare and not (kind == "placeholder" and out[-1][1] == "\n"):
            out[-1] = (kind, out[-1][1] + content)
        else:
            out.append((kind, content))
    return out


def placeholder_only(segments: Segments, ignore_blank: bool = False) -> bool:
    """No text at all; with ``ignore_blank`` text of white space does not count."""
    return not any(k == "text" and (c.strip() or not ignore_blank) for k, c in segments)


def _xml(text: str) -> str:
    return escape(text, {"\r": "&#13;"})


def build(segments: Segments) -> tuple[str, dict[str, str]]:
    """The unit and its placeholders by id."""
    parts, held = [], {}
    for kind, content in coalesce(segments):
        if kind == "text":
            parts.append(_xml(content))
        else:
            n = str(len(held) + 1)
            held[n] = content
            parts.append(f"<PH id={quoteattr(n)}>{_xml(content)}</PH>")
    return f"<document><TEXT>{''.join(parts)}</TEXT></document>", held


def reconstruct(unit: str, placeholders: dict[str, str]) -> str:
    """The text of a unit: placeholders by id, else their own text; unknown elements fall away but not what follows them.

    A unit without <TEXT> is ''; XML that is not well formed raises ``xml.etree.ElementTree.ParseError``.
    """
    root = ET.fromstring(unit)
    body = root if root.tag == "TEXT" else root.find(".//TEXT")
    if body is None:
        return ""
    out = [body.text or ""]
    for e in body:
        if e.tag == "PH":
            out.append(placeholders.get(e.get("id", ""), "".join(e.itertext())))
        out.append(e.tail or "")
    return "".join(out)
