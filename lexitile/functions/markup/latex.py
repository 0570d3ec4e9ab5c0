r"""LaTeX: a scanner over positions, nested groups on a stack of its own.

Text is what a reader sees; commands, references, math, code and layout signs are placeholders. Math exposes only the
arguments of text-like commands. Groups and environments nest; an unclosed one runs to the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Generator

from lexitile.functions.markup.stack import run

#: Commands and environments by how they are treated.
WHOLE_COMMANDS = {"ref", "autoref", "cite", "label", "includegraphics", "input", "include", "frac", "sqrt", "path", "url", "href", "\\", "verb"}
WHOLE_ENVS = {"verbatim", "Verbatim", "lstlisting", "minted"}
MATH_ENVS = {"equation", "equation*", "align", "align*", "aligned", "gather", "gather*", "gathered", "flalign", "flalign*", "alignat", "alignat*", "multline", "multline*", "displaymath", "math", "eqnarray", "eqnarray*"}
MATH_TEXT = {"text", "mathrm", "mathbf", "operatorname", "mathit", "textrm", "textit", "mathsf", "mathtt", "boldsymbol"}
DEFINITIONS = {"newcommand", "renewcommand", "newenvironment", "renewenvironment", "def"}
ALIGNED_ENVS = {"tabular", "tabular*", "array", "align", "align*", "aligned", "flalign", "flalign*", "alignat", "alignat*", "gather", "gather*"}
BLOCK_COMMANDS = {"section", "subsection", "subsubsection", "chapter", "part", "paragraph", "subparagraph", "title", "maketitle"}
#: Fixed value: inline chunks are closed at this length.
INLINE_LIMIT = 600

COMMAND = re.compile(r"\\([A-Za-z@]+\*?|.|\n)", re.S)
VERB = re.compile(r"\\verb\*?([^A-Za-z\s]).*?\1")
PIPE = re.compile(r"\\[A-Za-z]+\*?\|[^|]*\|")
BEGIN = re.compile(r"\\begin\s*\{([^{}]*)\}")
SPECIAL = re.compile(r"~|&|#\d?|---?|``|''|!`|\?`")
PLAIN = re.compile(r"[^\\%${}~&#\-`'!?]+")
PARAGRAPH = re.compile(r"\n\s*\n+")


def closing(s: str, i: int, end: int, left: str, right: str) -> int:
    """Position after the bracket that closes the one at i; end if it stays open."""
    depth = 0
    while i < end:
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == left:
            depth += 1
        elif c == right:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return end


BRACE = re.compile(r"\\.|[{}]", re.S)


def braces(s: str) -> dict[int, int]:
    """Position after the brace that closes each one, in a single pass."""
    out, opened = {}, []
    for m in BRACE.finditer(s):
        if m.group() == "{":
            opened.append(m.start())
        elif m.group() == "}" and opened:
            out[opened.pop()] = m.end()
    return out | dict.fromkeys(opened, len(s) + 1)


def arguments(s: str, i: int, end: int, pairs: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Bracket groups that follow position i directly or after blanks; ``pairs`` has the ends of braces found before."""
    out = []
    while True:
        j = i
        while j < end and s[j] in " \t":
            j += 1
        if j < end and s[j] == "[" and (j == i or not any(s[a] == "{" for a, _ in out)):
            k = closing(s, j, end, "[", "]")
        elif j < end and s[j] == "{":
            k = min(pairs[j], end) if pairs and j in pairs else closing(s, j, end, "{", "}")
        else:
            return out
        out.append((j, k))
        i = k


def env_end(s: str, name: str, i: int, end: int) -> tuple[int, int]:
    """Start and end of the ``\\end`` that closes an environment whose body starts at i."""
    depth = 1
    for m in re.compile(r"\\(begin|end)\s*\{" + re.escape(name) + r"\}").finditer(s, i, end):
        depth += 1 if m.group(1) == "begin" else -1
        if not depth:
            return m.start(), m.end()
    return end, end


def math_end(s: str, i: int, end: int) -> tuple[str, int, int] | None:
    """Opening sign, start and end of the closing sign of math that starts at i."""
    for left, right in (("$$", "$$"), ("$", "$"), ("\\(", "\\)"), ("\\[", "\\]")):
        if s.startswith(left, i):
            j = i + len(left)
            while j < end and not s.startswith(right, j):
                j += 2 if s[j] == "\\" else 1
            return (left, j, min(end, j + len(right))) if j < end else None
    return None


class Scanner:
    def __init__(self, s: str, whole: set[str], envs: set[str], math_text: set[str]):
        self.s, self.whole, self.envs, self.math_text = s, WHOLE_COMMANDS | whole, WHOLE_ENVS | envs, MATH_TEXT | math_text
        self.out: list[tuple[str, str]] = []
        self.pairs = braces(s)

    def close(self, i: int, end: int) -> int:
        return min(self.pairs[i], end) if i in self.pairs else closing(self.s, i, end, "{", "}")

    def keep(self, content: str) -> None:
        if content:
            self.out.append(("placeholder", content))

    def text(self, content: str) -> None:
        if content:
            self.out.append(("text" if content.strip() else "placeholder", content))

    def walk(self, i: int, end: int, math: bool = False, definition: bool = False) -> Generator:
        """Scan s[i:end]; in math everything but text commands is kept, in a definition math is kept whole."""
        s, start = self.s, i
        while i < end:
            c = s[i]
            j = i
            if c == "\\":
                m = VERB.match(s, i, end) or PIPE.match(s, i, end)
                if m:
                    j = m.end()
                elif s[i + 1 : i + 2] in ("(", "[") and (found := math_end(s, i, end)):
                    self.flush(start, i, math)
                    yield self.math(i, *found, whole=math or definition)
                    i = start = found[2]
                    continue
                elif (b := BEGIN.match(s, i, end)) and not math:
                    self.flush(start, i, math)
                    i = start = yield self.environment(i, b, end)
                    continue
                else:
                    self.flush(start, i, math)
                    i = start = yield self.command(i, end, math, definition)
                    continue
            elif c == "%" and not math:
                j = s.find("\n", i, end)
                j = end if j < 0 else j
                self.flush(start, i, math)
                k = i
                while k < j and s[k] in "% ":
                    k += 1
                self.keep(s[i:k])
                self.text(s[k:j])
                m = re.compile(r"\n[ \t]*").match(s, j, end)
                i = start = m.end() if m else j
                self.keep(s[j:i])
                continue
            elif c == "$":
                found = math_end(s, i, end)
                if found and not math:
                    self.flush(start, i, math)
                    yield self.math(i, *found, whole=definition)
                    i = start = found[2]
                    continue
                j = i + 1
            elif c == "{" and not math:
                k = self.close(i, end)
                shut = k if s[k - 1] == "}" and k > i + 1 else None
                self.flush(start, i, math)
                self.keep("{")
                yield self.walk(i + 1, k - 1 if shut else k, definition=definition)
                self.keep("}" if shut else "")
                i = start = k
                continue
            elif c == "}" and not math:
                j = i + 1
            elif math:
                i += 1
                continue
            elif m := SPECIAL.match(s, i, end):
                j = m.end()
            else:
                m = PLAIN.match(s, i, end)
                i = m.end() if m else i + 1
                continue
            self.flush(start, i, math)
            self.keep(s[i:j])
            i = start = j
        self.flush(start, end, math)

    def flush(self, a: int, b: int, math: bool) -> None:
        (self.keep if math else self.text)(self.s[a:b])

    def math(self, i: int, left: str, a: int, b: int, whole: bool) -> Generator:
        if whole:
            self.keep(self.s[i:b])
            return
        self.keep(left)
        yield self.walk(i + len(left), a, math=True)
        self.keep(self.s[a:b])

    def command(self, i: int, end: int, math: bool, definition: bool) -> Generator:
        s, m = self.s, COMMAND.match(self.s, i, end)
        if m is None:
            self.keep(s[i:end])
            return end
        name = m.group(1).rstrip("*") or m.group(1)
        args = arguments(s, m.end(), end, self.pairs) if m.group(1)[0].isalpha() else []
        if math and name not in self.math_text:
            self.keep(m.group())
            return m.end()
        if name in DEFINITIONS and args:
            if name == "def":
                k = s.find("{", m.end(), end)
                args = [(k, self.close(k, end))] if k >= 0 else args
            a, b = args[-1]
            self.keep(s[i : a + 1])
            yield self.walk(a + 1, b - 1, definition=True)
            self.keep(s[b - 1 : b])
            return b
        if name in self.whole:
            b = args[-1][1] if args else m.end()
            self.keep(s[i:b])
            return b
        at = i
        for a, b in args:
            self.keep(s[at : a + 1])
            yield self.walk(a + 1, b - 1, definition=definition)
            self.keep(s[b - 1 : b])
            at = b
        if not args:
            self.keep(m.group())
            return m.end()
        return at

    def environment(self, i: int, b: re.Match, end: int) -> Generator:
        s, name = self.s, b.group(1)
        a, z = env_end(s, name, b.end(), end)
        head = args[-1][1] if (args := arguments(s, b.end(), a, self.pairs)) else b.end()
        if name in self.envs or head >= a:
            self.keep(s[i:z])
            return z
        self.keep(s[i:head])
        if name in MATH_ENVS:
            yield self.walk(head, a, math=True)
        else:
            yield self.walk(head, a)
        self.keep(s[a:z])
        return z


def segment_latex(text: str, whole_commands: tuple[str, ...] = (), whole_envs: tuple[str, ...] = (), text_commands: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    if "\\end{document}" in text and "\\begin{document}" not in text:
        return [("placeholder", text)]
    scan = Scanner(text, set(whole_commands), set(whole_envs), set(text_commands))
    run(scan.walk(0, len(text)))
    return scan.out


def nodes(s: str, i: int, end: int) -> list[tuple[str, int, int]]:
    """Top-level nodes ``(kind, start, end)``: environments, block commands, others."""
    out, start = [], i
    while i < end:
        j, kind = i, ""
        if s[i] == "%":
            j = s.find("\n", i, end)
            i = end if j < 0 else j
            continue
        if s[i] == "\\":
            if b := BEGIN.match(s, i, end):
                j, kind = env_end(s, b.group(1), b.end(), end)[1], "environment"
            elif m := VERB.match(s, i, end):
                i = m.end()
                continue
            elif (m := COMMAND.match(s, i, end)) and m.group(1).rstrip("*") in BLOCK_COMMANDS:
                args = arguments(s, m.end(), end)
                j, kind = args[-1][1] if args else m.end(), "block"
        if kind:
            if start < i:
                out.append(("inline", start, i))
            out.append((kind, i, j))
            i = start = j
        elif found := (math_end(s, i, end) if s[i] in "$\\" else None):
            i = found[2]
        else:
            i += 2 if s[i] == "\\" else 1
    if start < end:
        out.append(("inline", start, end))
    return out


def body_chunks(s: str, i: int, end: int) -> list[str]:
    """Environments and block commands alone; other text by paragraphs, a chunk closing once it reaches the limit."""
    out = []
    for kind, a, b in nodes(s, i, end):
        if kind != "inline":
            out.append(s[a:b].strip())
            continue
        for paragraph in PARAGRAPH.split(s[a:b]):
            held = ""
            for piece in re.split(r"(?<=\s)(?=\\[A-Za-z])", paragraph):
                held += piece
                if len(held) >= INLINE_LIMIT:
                    out.append(held.strip())
                    held = ""
            out.append(held.strip())
    return [c for c in out if c]


def chunk_latex(text: str) -> list[dict]:
    """Preamble, document begin, body and end; without a document environment the whole text is body."""
    a, z = text.find("\\begin{document}"), text.rfind("\\end{document}")
    if a < 0:
        parts = body_chunks(text, 0, len(text))
    else:
        b = a + len("\\begin{document}")
        z = z if z >= b else len(text)
        parts = [text[:a].strip(), text[a:b], *body_chunks(text, b, z), text[z:].strip()]
    return [{"kind": "latex", "content": c} for c in parts if c]
