"""Scalar functions on keys, paths and languages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The languages, their directory suffixes and the document types by file suffix.
LANGUAGES = ("English", "French", "German", "Spanish", "Ukrainian", "Armenian")
DIR_SUFFIX = {"French": "_fr", "English": "_en", "German": "_de", "Spanish": "_es", "Ukrainian": "_ua", "Armenian": "_hy"}
DOC_TYPES = {"tex": "latex", "ipynb": "jupyter", "md": "markdown", "typ": "typst"}
#: White space in the sense of Python's str.isspace, as a Java character class.
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"


def content_checksum(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, 64 hex digits; nothing is stripped or normalised."""
    return F.sha2(c, 256)


def normalize_path(c: Column) -> Column:
    """POSIX form of a relative path: './', '//' and a last '/' fall away, '..' stays, '' is '.'."""
    p = F.regexp_replace(c, "/{2,}", "/")
    p = F.regexp_replace(p, r"(?<=^|/)(?:\./)+", "")
    p = F.regexp_replace(p, r"(?<=/)\.$", "")
    p = F.when(p != "/", F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(p == "", ".").otherwise(p)


def path_checksum(c: Column) -> Column:
    return F.sha2(normalize_path(c), 256)


def document_type(path: Column, has_notebook_header: Column | None = None) -> Column:
    """Type by suffix, case-sensitive; a Markdown file with a notebook header is a notebook."""
    suffix = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.when(suffix == "tex", "latex").when(suffix == "ipynb", "jupyter").when(suffix == "typ", "typst")
    if has_notebook_header is not None:
        out = out.when((suffix == "md") & has_notebook_header, "jupyter")
    return out.when(suffix == "md", "markdown").otherwise("other")


def parse_language(c: Column) -> Column:
    """The language named in any case; NULL if it is none."""
    return F.create_map(*[x for n in LANGUAGES for x in (F.lit(n.lower()), F.lit(n))])[F.lower(c)]


def dir_suffix(lang: Column) -> Column:
    return F.create_map(*[x for kv in DIR_SUFFIX.items() for x in map(F.lit, kv)])[lang]


def is_blank(c: Column) -> Column:
    """Empty or all white space."""
    return c.rlike(rf"\A{SPACE}*\z")


def clean_key(c: Column) -> Column:
    """Trimmed lower-case key, '' for NULL: '' is the wildcard path and the missing checksum."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))
