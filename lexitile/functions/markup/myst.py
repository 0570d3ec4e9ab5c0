"""MyST: a line scanner for blocks and one expression for inline markup.

Nothing is normalised: every sign of the source comes back in a segment. Directives with prose bodies are scanned recursively,
all others are kept whole.
"""

from __future__ import annotations

import re
from collections.abc import Generator

from lexitile.functions.markup.stack import run

#: Directives with a title and prose, options that hold prose, roles whose text is prose.
TITLED = {"admonition", "attention", "caution", "danger", "error", "hint", "important", "note", "seealso", "tip", "warning", "aside", "sidebar", "topic", "dropdown"}
PROSE_BODY = TITLED | {"figure"}
PROSE_OPTIONS = {"figure": {"alt"}, "image": {"alt"}, "video": {"alt"}}
PROSE_ROLES = {"definiendum"}
#: Fixed value: longer sections are cut into their blocks.
SECTION_LIMIT = 2000

FENCE = re.compile(r"^([ \t]*)(`{3,}|~{3,}|:{3,})[ \t]*(?:\{([\w:.-]+)\})?([^\n`]*)$")
HEADING = re.compile(r"^([ \t]{0,3}#{1,6})([ \t]+|$)(.*?)([ \t]+(?:#+|\{[#.][^{}]*\}))?[ \t]*$")
#: List items, definitions, footnotes.
MARKER = re.compile(r"^([ \t]*(?:[-+*]|\d{1,9}[.)]|:|\[\^[^\]\s]+\]:)(?:[ \t]+|$))(\[[ xX]\][ \t]+)?")
ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$")
PIPE = re.compile(r"[ \t]*(?<!\\)\|[ \t]*")
QUOTE = re.compile(r"^([ \t]*(?:>[ \t]?)+)")
OPAQUE = re.compile(r"^[ \t]*(?:%.*|\([\w:. -]+\)=[ \t]*|\+\+\+.*|(?:[-*_][ \t]*){3,}|={2,}[ \t]*|-{2,}[ \t]*|:[\w-]+:.*|\|?[ \t]*:?-{3,}.*\|.*|\{[#.][^}]*\}[ \t]*)$")
OPTION = re.compile(r"^([ \t]*:([\w-]+):[ \t]*)(.*)$")
HTML = re.compile(r"^[ \t]*</?[A-Za-z!][^\n]*$")
INLINE = re.compile(
    r"(?P<role>\{[\w:.-]+\}(`+).+?\2)|(?P<code>(`+)(?!`).+?(?<!`)\4(?!`))|(?P<math>\$\$.+?\$\$|(?<![\\$])\$(?!\s)[^$\n]+?(?<![\s\\])\$)"
    r"|(?P<sub>\{\{.+?\}\})|(?P<foot>\[\^[^\]\s]+\])|(?P<link>!?\[)|(?P<tail>\]\((?:[^()\s]|\([^()]*\))*(?:[ \t]+\"[^\"\n]*\")?\)|\]\[[^\]\n]*\])"
    r"|(?P<html></?[A-Za-z][^<>\n]*>|<!--.*?-->)|(?P<auto><?https?://[^\s<>)\]]+>?)|(?P<esc>\\[!-/:-@\[-`{-~]|\\$)|(?P<mark>\*{1,3}|(?<!\w)_{1,2}(?=\S)|(?<=\S)_{1,2}(?!\w))|(?P<br> {2,}$)",
    re.S | re.M,
)

Segments = list[tuple[str, str]]


def inline(text: str) -> Segments:
    out: Segments = []
    at = 0

    def plain(piece: str) -> None:
        if piece:
            out.append(("text" if piece.strip() else "placeholder", piece))

    for m in INLINE.finditer(text):
        plain(text[at : m.start()])
        at, kind = m.end(), m.lastgroup
        role = re.match(r"\{([\w:.-]+)\}(`+)", m.group()) if m.group("role") else None
        if role and role.group(1) in PROSE_ROLES:
            ticks = role.group(2)
            body = m.group()[role.end() : -len(ticks)]
            t = re.fullmatch(r"(.*?)(\s*<)(.*)(>)", body, re.S)
            out.append(("placeholder", role.group()))
            if t:
                plain(t.group(1))
                out.append(("placeholder", t.group(2)))
                plain(t.group(3))
                out.append(("placeholder", t.group(4) + ticks))
            else:
                plain(body)
                out.append(("placeholder", ticks))
        else:
            out.append(("math" if kind == "math" else "placeholder", m.group()))
    plain(text[at:])
    return out


def closing_line(lines: list[str], i: int, end: int, mark: str) -> int:
    """Line that closes a fence opened before line i; end if none does."""
    shut = re.compile(r"^[ \t]*" + re.escape(mark[0]) + "{%d,}[ \t]*$" % len(mark))
    deep = re.compile(r"^[ \t]*" + re.escape(mark[0]) + "{%d,}[ \t]*\\{" % len(mark))
    depth = 0
    for k in range(i, end):
        if shut.match(lines[k]):
            if not depth:
                return k
            depth -= 1
        elif mark[0] == ":" and deep.match(lines[k]):
            depth += 1
    return end


def blocks(lines: list[str], i: int, end: int) -> list[tuple[str, int, int]]:
    """``(kind, first line, line after)``: fences, math, front matter, headings, other runs of non-blank lines."""
    out = []
    if i == 0 and end and lines[0].strip() == "---":
        k = next((k for k in range(1, end) if lines[k].strip() in ("---", "...")), None)
        if k is not None:
            out.append(("front", 0, k + 1))
            i = k + 1
    while i < end:
        if not lines[i].strip():
            i += 1
            continue
        f = FENCE.match(lines[i])
        if f:
            k = min(end, closing_line(lines, i + 1, end, f.group(2)) + 1)
            out.append(("fence", i, k))
        elif lines[i].strip().startswith("$$"):
            k = i + 1 if lines[i].strip().count("$$") > 1 else next((k + 1 for k in range(i + 1, end) if "$$" in lines[k]), end)
            out.append(("math", i, k))
        elif HEADING.match(lines[i]):
            k = i + 1
            out.append(("heading", i, k))
        elif OPAQUE.match(lines[i]):
            k = i + 1
            out.append(("opaque", i, k))
        else:
            k = i + 1
            listed = bool(MARKER.match(lines[i]))
            while k < end:
                line = lines[k]
                if not line.strip():
                    n = next((x for x in range(k, end) if lines[x].strip()), end)
                    if listed and n < end and (MARKER.match(lines[n]) or lines[n][:1] in " \t"):
                        k = n
                        continue
                    break
                if not (listed and line[:1] in " \t") and (FENCE.match(line) or HEADING.match(line) or OPAQUE.match(line) or line.strip().startswith("$$")):
                    break
                k += 1
            out.append(("list" if listed else "paragraph", i, k))
        i = k
    return out


def segment_lines(lines: list[str], i: int, end: int, top: bool, out: Segments) -> Generator:
    """Segments of the lines, which keep their line ends."""
    bare = [x.rstrip("\r\n") for x in lines]
    at = i
    spans = blocks(bare, i, end) if top else blocks([""] * i + bare[i:end], i, end)
    for kind, a, b in spans:
        out.append(("placeholder", "".join(lines[at:a])))
        at = b
        if kind in ("front", "math", "opaque"):
            out.append(("placeholder", "".join(lines[a:b])))
        elif kind == "fence":
            yield fence(lines, bare, a, b, out)
        elif kind == "heading":
            m = HEADING.match(bare[a])
            out.append(("placeholder", m.group(1) + m.group(2)))
            out += inline(m.group(3))
            out.append(("placeholder", lines[a][m.end(3) :]))
        else:
            yield prose(lines, bare, a, b, out)
    out.append(("placeholder", "".join(lines[at:end])))


def prose(lines: list[str], bare: list[str], a: int, b: int, out: Segments) -> Generator:
    """Paragraphs, quotes and lists: marks and indents are placeholders; soft line ends are text outside of lists and quotes."""
    k, held, margin = a, "", ""
    while k < b:
        f = FENCE.match(bare[k])
        if f and (k > a or not f.group(1)):
            out += inline(held)
            held = ""
            n = min(b, closing_line(bare, k + 1, b, f.group(2)) + 1)
            yield fence(lines, bare, k, n, out)
            k = n
            continue
        line, prefix = lines[k], ""
        while m := (QUOTE.match(line[len(prefix) :]) or MARKER.match(line[len(prefix) :])):
            if not m.group():
                break
            prefix += m.group()
        if not prefix:
            prefix = re.match(r"[ \t]*", line).group()
        opaque = OPAQUE.match(bare[k]) or HTML.match(bare[k])
        if opaque or not bare[k].strip():
            out += inline(held)
            held = ""
            out.append(("placeholder", line))
        else:
            body, end = bare[k][len(prefix) :], line[len(bare[k]) :]
            if prefix or not held:
                out += inline(held)
                held = ""
                out.append(("placeholder", prefix))
            if not held and ROW.match(body):
                cells(body, out)
                out.append(("placeholder", end))
                k += 1
                continue
            held += body
            more = k + 1 < b and bare[k + 1].strip() and not MARKER.match(bare[k + 1]) and not QUOTE.match(bare[k + 1]) and bare[k + 1][:1] not in " \t" and not FENCE.match(bare[k + 1]) and not OPAQUE.match(bare[k + 1]) and not HTML.match(bare[k + 1]) and not ROW.match(bare[k + 1])
            if more and not prefix:
                held += end
            else:
                out += inline(held)
                held = ""
                out.append(("placeholder", end))
        k += 1
    out += inline(held)


def cells(row: str, out: Segments) -> None:
    """The cells of a table row, each by itself; what parts them is kept."""
    at = 0
    for m in PIPE.finditer(row):
        out += inline(row[at : m.start()])
        out.append(("placeholder", m.group()))
        at = m.end()
    out += inline(row[at:])


def fence(lines: list[str], bare: list[str], a: int, b: int, out: Segments) -> Generator:
    f = FENCE.match(bare[a])
    name = f.group(3)
    shut = b - 1 if b - 1 > a and re.match(r"^[ \t]*" + re.escape(f.group(2)[0]) + "{3,}[ \t]*$", bare[b - 1]) else b
    if name not in PROSE_BODY and name not in PROSE_OPTIONS:
        out.append(("placeholder", "".join(lines[a:b])))
        return
    title = f.group(4)
    head = len(bare[a]) - len(title) + len(title) - len(title.lstrip())
    if name in TITLED:
        out.append(("placeholder", lines[a][:head]))
        out += inline(title.strip())
        out.append(("placeholder", lines[a][head + len(title.strip()) :]))
    else:
        out.append(("placeholder", lines[a]))
    k = a + 1
    while k < shut and (m := OPTION.match(bare[k])):
        if m.group(2) in PROSE_OPTIONS.get(name, ()) and m.group(3).strip():
            out.append(("placeholder", m.group(1)))
            out.append(("text", m.group(3)))
            out.append(("placeholder", lines[k][m.end() :]))
        else:
            out.append(("placeholder", lines[k]))
        k += 1
    if name in PROSE_BODY:
        yield segment_lines(lines, k, shut, False, out)
    else:
        out.append(("placeholder", "".join(lines[k:shut])))
    out.append(("placeholder", "".join(lines[shut:b])))


def split_lines(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+\Z", text)


def segment_myst(text: str) -> Segments:
    out: Segments = []
    lines = split_lines(text)
    run(segment_lines(lines, 0, len(lines), True, out))
    return out


def chunk_myst(text: str) -> list[dict]:
    """Sections that start at headings; a section above the limit comes as its blocks. Gap lines belong to the block before."""
    lines = text.splitlines()
    spans = blocks(lines, 0, len(lines))
    starts = [a for _, a, _ in spans]
    parts = []
    for n, (kind, a, b) in enumerate(spans):
        stop = starts[n + 1] if n + 1 < len(spans) else b
        parts.append((kind, "".join(x + "\n" for x in lines[a:stop])))
    sections: list[list[tuple[str, str]]] = []
    for p in parts:
        if p[0] == "heading" or not sections:
            sections.append([])
        sections[-1].append(p)
    out = []
    for s in sections:
        whole = "".join(c for _, c in s)
        out += [{"kind": k, "content": c} for k, c in s] if len(whole) > SECTION_LIMIT else [{"kind": "section", "content": whole}]
    return out
