"""Which paths of a repository are read: the exclusion policy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strataloom.functions.text import words_array

# Directories, files and endings that are left out.
EXCLUDED_DIRECTORIES = (".cache", ".git", ".mypy_cache", ".pip-cache", ".pytest_cache", ".ruff_cache", ".temp", ".tmp", ".tox", ".uv-cache", ".venv", "__pycache__", "build", "dist", "generated", "node_modules", "target", "temp", "tmp", "uv-cache", "vendor", "venv")
EXCLUDED_NAMES = (".env", ".env.local", "credentials.json", "secrets.json")
EXCLUDED_ENDINGS = (".bin", ".dll", ".dylib", ".exe", ".key", ".p12", ".pem", ".pyc", ".pyo", ".so")
SUPPORTED_ENDINGS = (".py", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".md", ".markdown")


def exclusion_root(path: Column) -> Column:
    """The path up to its first excluded directory, or null."""
    parts = F.split(path, "/")
    first = F.array_position(F.transform(parts, lambda p: F.array_contains(words_array(EXCLUDED_DIRECTORIES), p)), True)
    return F.when(first > 0, F.array_join(F.slice(parts, F.lit(1), first.cast("int")), "/"))


def exclusion_reason(path: Column) -> Column:
    """policy_excluded, sensitive_or_binary, unsupported_file_type or null.

    Names count as they are written and endings in any case; what begins with its only dot has
    no ending, nor has what ends with a dot.
    """
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    return (
        F.when(exclusion_root(path).isNotNull(), "policy_excluded").when(name.isin(*EXCLUDED_NAMES) | ending.isin(*EXCLUDED_ENDINGS), "sensitive_or_binary")
        .when(~ending.isin(*SUPPORTED_ENDINGS), "unsupported_file_type")
    )
