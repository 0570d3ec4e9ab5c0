"""Plain helpers shared by the text operators: markup removal, words and sentences.

Everything here works on one Python string; the operators call it from Arrow batches.
"""

from __future__ import annotations

import re

#: Stretches that belong to no language: code, math, commands, labels, references, tags, table and list marks.
MARKUP = re.compile(
    r"```.*?(?:```|\Z)"
    r"|\\begin\{(verbatim|lstlisting|minted|align|equation|gather|multline|math|displaymath)(\*?)\}.*?(?:\\end\{\1\2\}|\Z)"
    r"|\$\$.*?(?:\$\$|\Z)|\\\[.*?\\\]|\\\(.*?\\\)"
    r"|\{[\w:-]+\}`[^`\n]*`|`[^`\n]*`|\$[^$\n]*\$"
    r"|!\[[^\]\n]*\]\([^)\n]*\)"
    r"|https?://\S+"
    r"|\\(?:begin|end|label|cite|ref|eqref|autoref|includegraphics|usepackage|documentclass)\*?(?:\[[^\]\n]*\])?\{[^}\n]*\}?"
    r"|^[ \t]*%[^\n]*|^[ \t]*//[^\n]*"
    r"|\([\w:.-]*\d[\w:.-]*\)=|\{#[^}\n]*\}|^:{3,}(?:\{[^}\n]*\})?[^\S\n]*|</?[A-Za-z][^<>\n]*(?:>|\Z)|\[@[^\]\n]*\]|@[\w:-]+"
    r"|#(?:block|align|box|emph|strong|figure|quote)\b(?:\([^)\n]*\))?|#[a-z][\w.]*\([^)\n]*\)"
    r"|^[ \t]*(?:[-+*]|\d+[.)]|={1,6}|\#{1,6})[ \t]+|\\[A-Za-z]+\*?"
    r"|“[A-Za-z]*\d+”|[{}\[\]|#>~^_*]|\\(?![A-Za-z])",
    re.S | re.M,
)
WORD = re.compile(r"[^\W\d_]+(?:[’'՚՛՜՞][^\W\d_]+)*")
#: Ends of sentences: the usual marks, the Armenian full stop, line ends.
SENTENCE_END = re.compile(r"(?<=[.!?…։])[”\"»)]*\s+|(?<=:)\s+|\n+|\s[/|]\s|;\s")


def blank_markup(text: str | None) -> str:
    """The text with markup, code and math replaced by blanks; '' for None."""
    return MARKUP.sub(" ", text) if text else ""


def is_prose(words: list[str]) -> bool:
    """True for words that belong to a language: at least one starts in lower case and has two letters.

    Single capitalised words are taken for names ('Kappa', 'TeX', 'HTTP').
    """
    return any(len(w) > 1 and w[0].islower() for w in words)


def prose_sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence that holds prose, in text order."""
    return blank_sentences(blank_markup(text))


def blank_sentences(blank: str) -> list[list[str]]:
    """As ``prose_sentences``, of a text whose markup is blanked already."""
    out = []
    for part in SENTENCE_END.split(blank):
        if part:
            words = WORD.findall(part)
            if words and is_prose(words):
                out.append(words)
    return out


#: Marks around content: like MARKUP, but code and math between them count as content.
MARKS = re.compile(
    r"```[\w-]*|\\(?:begin|end|label|noindent|item|section|subsection|caption)\*?(?:\[[^\]\n]*\])?(?:\{[\w:.*-]*\})?"
    r"|^[ \t]*%[^\n]*|\([\w:.-]*\d[\w:.-]*\)=|\{#[^}\n]*\}|^:{3,}(?:\{[^}\n]*\})?|</?[A-Za-z][^<>\n]*>"
    r"|#(?:block|align|box|emph|strong|figure|quote)\b(?:\([^)\n]*\))?|#h\([^)\n]*\)",
    re.M,
)


def holds_content(text: str | None) -> bool:
    """Any letter or digit besides tags, fences, labels and other marks."""
    return bool(text) and any(c.isalnum() for c in MARKS.sub(" ", text))
