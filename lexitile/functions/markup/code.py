"""Code: comments and string bodies are text, all else is kept."""

from __future__ import annotations

import re

_C = r"//[/!]*(?P<line>[^\n]*)|/\*[*!]?(?P<block>.*?)\*/"
#: Comments and strings by language.
PATTERNS = {
    "python": re.compile(r"#+(?P<line>[^\n]*)|[rRbBuUfF]{0,2}(?P<q>\"\"\"|'''|\"|')(?P<str>(?:\\.|(?!(?P=q)).)*?)(?P=q)", re.S),
    "java": re.compile(_C + r"|\"\"\"(?P<text>.*?)\"\"\"|\"(?P<str>(?:\\.|[^\"\\\n])*)\"|'(?:\\.|[^'\\])'", re.S),
    "rust": re.compile(_C + r"|(?P<whole>b?\"(?:\\.|[^\"\\])*\"|b?r(?P<h>#*)\".*?\"(?P=h))|'(?:\\.|[^'\\])'", re.S),
}


def segment_code(text: str, language: str = "python") -> list[tuple[str, str]]:
    out, at = [], 0
    pattern = PATTERNS.get(language)
    for m in pattern.finditer(text) if pattern else ():
        group = next((g for g in ("line", "block", "str", "text", "whole") if m.groupdict().get(g)), None)
        if group is None or not m.group(group).strip():
            continue
        out += [("placeholder", text[at : m.start(group)]), ("text", m.group(group))]
        at = m.end(group)
    out.append(("placeholder", text[at:]))
    return [(k, c) for k, c in out if c]
