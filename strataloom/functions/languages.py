"""One name for each language, from any spelling or else from the path's ending."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings by language, and path endings by language.
SPELLINGS = {
    "python": ("python", "py", "python3", "py3", "pyi"),
    "typescript": ("typescript", "ts", "tsx", "mts", "cts"),
    "javascript": ("javascript", "js", "jsx", "mjs", "cjs", "ecmascript", "es6", "node"),
    "go": ("go", "golang"),
    "rust": ("rust", "rs"),
    "markdown": ("markdown", "md", "mdx"),
}
ENDINGS = {
    "python": ("py", "pyi", "pyw"),
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "go": ("go",),
    "rust": ("rs",),
    "markdown": ("md", "markdown", "mdown"),
}
PROGRAMMING = ("python", "typescript", "javascript", "go", "rust")


def language_of(language: Column, path: Column) -> Column:
    """The language's one name; null if neither the spelling nor the path's ending tells."""
    spelled = F.regexp_replace(F.lower(F.trim(language)), r"[\s.]+", "")
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)\s*$", 1))
    pick = lambda c, known: F.coalesce(*(F.when(c.isin(*words), F.lit(name)) for name, words in known.items()))
    return F.coalesce(pick(spelled, SPELLINGS), pick(ending, ENDINGS))


def is_programming(language: Column, path: Column) -> Column:
    return F.coalesce(language_of(language, path).isin(*PROGRAMMING), F.lit(False))
