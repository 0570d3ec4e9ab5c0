"""Typst: a scanner over positions for markup, code and math mode."""

from __future__ import annotations

import re
from collections.abc import Generator

from lexitile.functions.markup.stack import run
from lexitile.functions.packing import packed

#: Named string arguments that are prose or never are, math functions that hold text, limits.
PROSE_ARGS = {"caption", "description", "info", "subtitle", "summary", "title"}
NEVER_ARGS = {"file", "id", "key", "label", "lang", "language", "path", "ref", "target", "url"}
MATH_TEXT = {"text", "upright", "bold", "italic"}
INLINE_LIMIT = 600
SECTION_LIMIT = 2000

HASH = re.compile(r"#(?:(let|set|show|import|include|if|for|while|return|context)\b|([A-Za-z_][\w.-]*)|([({\[\"]))")
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
RAW = re.compile(r"(`{3,}).*?\1|`[^`]*`", re.S)
LINE_MARK = re.compile(r"(?:={1,6}|[-+]|\d+\.|/)[ \t]+")
PARBREAK = re.compile(r"\n[ \t]*(?:\r?\n[ \t]*)+")
LABEL = re.compile(r"<[\w:.-]+>|@[\w:.-]*\w")
LINK = re.compile(r"https?://[^\s\])}>]+")
NAME = re.compile(r"[A-Za-z_][\w-]*")

Segments = list[tuple[str, str]]


def balanced(s: str, i: int, end: int, known: dict[int, int] | None = None) -> int:
    """Position after the bracket that closes the one at i, strings, raw text and comments left aside.

    ``known`` takes the ends of all brackets passed, so that those inside need no scan of their own.
    """
    pair, stack, known = {"(": ")", "[": "]", "{": "}"}, [], {} if known is None else known
    if i in known:
        return min(known[i], end)
    while i < end:
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == '"' and (not stack or stack[-1][0] != "]") and (m := STRING.match(s, i, end)):
            i = m.end()
            continue
        if c == "`" and (m := RAW.match(s, i, end)):
            i = m.end()
            continue
        if s.startswith("//", i) and s[i - 1 : i] != ":":
            i = s.find("\n", i, end)
            if i < 0:
                break
            continue
        if c in pair:
            stack.append((pair[c], i))
        elif stack and c == stack[-1][0]:
            known[stack.pop()[1]] = i + 1
            if not stack:
                return i + 1
        i += 1
    known.update((at, len(s) + 1) for _, at in stack)
    return end


def code_end(s: str, i: int, end: int, known: dict[int, int] | None = None) -> tuple[str, int]:
    """Kind and end of the code that starts with the '#' at i."""
    m = HASH.match(s, i, end)
    if not m:
        return "hash", i + 1
    j = m.end()
    word = m.group(1)
    if m.group(3):
        return ("code", balanced(s, i + 1, end, known)) if m.group(3) != '"' else ("code", STRING.match(s, i + 1, end).end() if STRING.match(s, i + 1, end) else j)
    if word in ("let", "set", "show", "import", "include", "return"):
        while j < end and s[j] not in "\n;":
            if s[j] in "([{":
                j = balanced(s, j, end, known)
            elif m2 := STRING.match(s, j, end):
                j = m2.end()
            else:
                j += 1
        return word, j
    if word:
        while j < end and s[j] not in "\n{[":
            j = balanced(s, j, end, known) if s[j] == "(" else j + 1
        while j < end and s[j] in "{[":
            j = balanced(s, j, end, known)
            k = re.compile(r"[ \t]*else\b[^\n{\[]*").match(s, j, end)
            j = k.end() if k else j
        return "control", j
    while j < end and s[j] in "([":
        j = balanced(s, j, end, known)
        k = re.compile(r"\.[A-Za-z_][\w-]*(?=[(\[])").match(s, j, end)
        j = k.end() if k else j
    return "call", j


def math_close(s: str, i: int, end: int) -> int:
    """Position after the '$' that closes the one at i, or -1."""
    j = i + 1
    while j < end:
        if s[j] == "\\":
            j += 2
        elif s[j] == '"' and (m := STRING.match(s, j, end)):
            j = m.end()
        elif s[j] == "$":
            return j + 1
        else:
            j += 1
    return -1


def name_before(s: str, lo: int, at: int) -> str:
    """The name whose ':' stands right before a position; ''."""
    k = at
    while k > lo and s[k - 1].isspace():
        k -= 1
    if k <= lo or s[k - 1] != ":":
        return ""
    k -= 1
    while k > lo and s[k - 1].isspace():
        k -= 1
    z = k
    while k > lo and (s[k - 1].isalnum() or s[k - 1] in "_-"):
        k -= 1
    m = NAME.search(s, k, z)
    return m.group() if m and m.end() == z else ""


class Scanner:
    def __init__(self, s: str, args_by_function: dict[str, list[str]]):
        self.s, self.out, self.known = s, [], {}
        self.by_function = {k.strip().lower(): {x.strip().lower() for x in v} for k, v in args_by_function.items()}

    def keep(self, c: str) -> None:
        if c:
            self.out.append(("placeholder", c))

    def text(self, c: str) -> None:
        if c:
            self.out.append(("text", c))

    def is_prose(self, function: str, name: str) -> bool:
        """Deny-list, then the function's own list if it has one, else the default list."""
        name = name.lower()
        if name in NEVER_ARGS:
            return False
        own = self.by_function.get(function.lower())
        return name in own if own is not None else name in PROSE_ARGS

    def markup(self, i: int, end: int) -> Generator:
        s, start = self.s, i
        while i < end:
            c, j = s[i], i
            fresh = i == 0 or s[i - 1] in "\n[" or not s[s.rfind("\n", 0, i) + 1 : i].strip()
            if s.startswith("//", i) and s[i - 1 : i] != ":":
                j = s.find("\n", i, end)
                j = end if j < 0 else j
                self.text(s[start:i])
                k = i + 2 + (s[i + 2 : i + 3] == " ")
                self.keep(s[i : min(k, j)])
                self.text(s[k:j])
                i = start = j
                continue
            if s.startswith("/*", i):
                j = s.find("*/", i, end)
                j = end if j < 0 else j + 2
                self.text(s[start:i])
                a = i + 2 + (s[i + 2 : i + 3] == " ")
                z = j - 2 - (s[j - 3 : j - 2] == " " and j - 3 >= a) if s[j - 2 : j] == "*/" else j
                self.keep(s[i:a])
                self.text(s[a:z])
                self.keep(s[z:j])
                i = start = j
                continue
            if c == "`" and (m := RAW.match(s, i, end)):
                j = m.end()
            elif c == "$" and (j := math_close(s, i, end)) > 0:
                self.text(s[start:i])
                self.math(i, j)
                i = start = j
                continue
            elif c == "#":
                kind, j = code_end(s, i, end, self.known)
                self.text(s[start:i])
                yield self.code(i, j, kind)
                i = start = j
                continue
            elif c in "<@" and (m := LABEL.match(s, i, end)):
                j = m.end()
            elif c == "h" and (m := LINK.match(s, i, end)):
                j = m.end()
            elif c == "\n" and (m := PARBREAK.match(s, i, end)):
                j = m.end()
            elif c == "\\":
                j = min(end, i + 2)
            elif fresh and (m := LINE_MARK.match(s, i, end)):
                j = m.end()
            elif c in "*_" and not (s[i - 1 : i].isalnum() and s[i + 1 : i + 2].isalnum()):
                j = i + 1
            else:
                i += 1
                continue
            j = max(j, i + 1)
            self.text(s[start:i])
            self.keep(s[i:j])
            i = start = j
        self.text(s[start:end])

    def math(self, i: int, j: int) -> None:
        s = self.s
        pieces = [m for m in re.compile(r'(?:\b(?:%s)\()?"((?:[^"\\]|\\.)*)"\)?' % "|".join(sorted(MATH_TEXT)), re.S).finditer(s, i, j)]
        if not pieces:
            self.out.append(("math", s[i:j]))
            return
        at = i
        for m in pieces:
            self.keep(s[at : m.start(1)])
            self.text(m.group(1))
            at = m.end(1)
        self.keep(s[at:j])

    def code(self, i: int, j: int, kind: str) -> Generator:
        """Content blocks are markup; named string arguments are text where they are prose; all else is kept."""
        s = self.s
        name = HASH.match(s, i, j)
        function = (name.group(2) or "") if name else ""
        if name and name.group(1) in ("set", "show"):
            f = re.compile(r"\s+([A-Za-z_][\w.-]*)").match(s, name.end(), j)
            function = f.group(1) if f else ""
        if kind in ("import", "include"):
            self.keep(s[i:j])
            return
        at, k = i, i + 1
        while k < j:
            c = s[k]
            if c == "[":
                b = balanced(s, k, j, self.known)
                b -= self.known[k] <= j  # an unclosed block runs to the end
                self.keep(s[at : k + 1])
                yield self.markup(k + 1, b)
                at = k = b
                k += 1
            elif c == '"' and (m := STRING.match(s, k, j)):
                n = name_before(s, at, k)
                if n and self.is_prose(function, n):
                    self.keep(s[at : k + 1])
                    self.text(s[k + 1 : m.end() - 1])
                    at = m.end() - 1
                k = m.end()
            elif c == "`" and (m := RAW.match(s, k, j)):
                k = m.end()
            elif c == "$" and (z := math_close(s, k, j)) > 0:
                k = z
            else:
                k += 1
        self.keep(s[at:j])


def segment_typst(text: str, args_by_function: dict[str, list[str]] | None = None) -> Segments:
    scan = Scanner(text, args_by_function or {})
    run(scan.markup(0, len(text)))
    return [(k, c) for k, c in scan.out if c]


def pieces(text: str) -> list[tuple[str, str]]:
    """Atomic pieces: headings, raw blocks and rules alone; running text up to a paragraph break or the inline limit."""
    s, end, out = text, len(text), []
    i = start = 0

    def flush(to: int) -> None:
        nonlocal start
        if start < to:
            out.append(("inline", s[start:to]))
        start = to

    while i < end:
        fresh = i == 0 or s[i - 1] == "\n"
        if s[i] == "#":
            kind, j = code_end(s, i, end)
            if kind in ("let", "set", "show", "import", "include", "code"):
                flush(i)
                out.append((kind, s[i:j]))
                start = j
            i = max(j, i + 1)
            if i - start >= INLINE_LIMIT:
                flush(i)
        elif fresh and re.compile(r"={1,6}[ \t]").match(s, i, end):
            j = s.find("\n", i, end)
            j = end if j < 0 else j
            flush(i)
            out.append(("heading", s[i:j]))
            i = start = j
        elif s[i] == "`" and (m := RAW.match(s, i, end)):
            flush(i)
            out.append(("raw", m.group()))
            i = start = m.end()
        elif s[i] == "$" and (j := math_close(s, i, end)) > 0:
            i = j
            if i - start >= INLINE_LIMIT:
                flush(i)
        elif s[i] == "\n" and (m := PARBREAK.match(s, i, end)):
            i = m.end()
            flush(i)
        else:
            i += 1
            if i - start >= INLINE_LIMIT and (s[i - 1] == "\n" or s[i : i + 1] in ("\n", "$", "#", "*", "_", "@", "<", "`")):
                flush(i)
    flush(end)
    return out


def chunk_typst(text: str) -> list[dict]:
    """Sections that start at headings; a section above the limit is packed greedily, a longer piece stands alone."""
    sections: list[list[tuple[str, str]]] = []
    for p in pieces(text):
        if p[0] == "heading" or not sections:
            sections.append([])
        sections[-1].append(p)
    texts = [[c for _, c in sec] for sec in sections]
    out = ["".join(t[x]) for t in texts for x in packed([len(c) for c in t], SECTION_LIMIT)]
    return [{"kind": "typst", "content": c} for c in out if c]
