"""Weighted search over symbols as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataloom.functions.text import in_templates, name_words, query_words, words_array

# What kind of symbol weighs what, by language; others weigh 0.
KIND_WEIGHTS = {
    "python": {"function": 10, "method": 10, "class": 3, "constant": -5},
    "typescript": {"function": 10, "method": 10, "class": 8, "type": 8, "constant": -3},
    "javascript": {"function": 10, "method": 10, "class": 6, "constant": -3},
    "go": {"function": 10, "method": 10, "type": 8, "constant": -3},
    "rust": {"function": 10, "method": 10, "type": 6, "constant": -3},
    "": {"function": 8, "method": 8, "class": 4, "constant": -2},
}
# Words of questions that want a whole page.
PAGE_WORDS = ("overview", "manual", "page", "document", "doc", "readme", "guide")


def _when(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))


def _words_in(text: Column, words: list[str], each: float) -> Column:
    """``each`` for every word that the text contains anywhere."""
    out = F.lit(0.0)
    for w in words:
        out = out + _when(text.contains(w), each)
    return out


def kind_weight(kind: Column, language: Column) -> Column:
    """A known language has its own table, any other the general one."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, table in KIND_WEIGHTS.items():
        here = language == name if name else ~language.isin(*(x for x in KIND_WEIGHTS if x))
        inner = F.lit(0.0)
        for k, w in table.items():
            inner = F.when(kind == k, F.lit(float(w))).otherwise(inner)
        out = out.when(here, inner)
    return out.otherwise(F.lit(0.0))


def frontmatter_score(front: Column, query: str, words: list[str]) -> Column:
    """What a page's frontmatter adds; a null map adds nothing. Tags are split at commas."""
    low = lambda key: F.lower(F.coalesce(F.try_element_at(front, F.lit(key)), F.lit("")))
    asked = words_array(words)

    def text(key: str, exact: float, word: float) -> Column:
        value = low(key)
        return _when((value != "") & value.contains(query), exact) + F.size(F.array_intersect(query_words(value), asked)) * word

    tags = F.filter(F.transform(F.split(F.regexp_replace(low("tags"), r"[\[\]\"']", ""), ","), F.trim), lambda t: t != "")
    per_tag = F.transform(tags, lambda t: F.when(t == query, 16.0).when(t.contains(query), 10.0).otherwise(0.0) + F.size(F.array_intersect(query_words(t), asked)) * 4.0)
    total = F.aggregate(per_tag, F.lit(0.0), lambda a, b: a + b)
    for key, exact, word in (("title", 8, 2), ("category", 7, 2), ("type", 7, 2), ("source", 7, 2), ("status", 7, 2), ("description", 5, 1)):
        total = total + text(key, exact, word)
    return F.when(front.isNull(), 0.0).otherwise(total)


def local_score(query: str, words: list[str]) -> Column:
    """A symbol's score from its own name, signature, summary, docstring and keywords."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name, qualified, signature, summary = low("name"), low("qualified_name"), low("signature"), low("summary")
    asked = words_array(words)
    score = F.when(qualified == query, 25.0).when(qualified.contains(query), 12.0).otherwise(0.0)
    score = score + F.when(name == query, 20.0).when(name.contains(query), 10.0).otherwise(0.0)
    score = score + F.size(F.array_intersect(name_words(F.col("name")), asked)) * 5.0
    score = score + F.when(signature.contains(query), 8.0).otherwise(_words_in(signature, words, 2))
    score = score + F.when(summary == "", 0.0).when(summary.contains(query), 5.0).otherwise(_words_in(summary, words, 1))
    score = score + _words_in(low("docstring"), words, 1)
    keys = F.array_distinct(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower))
    return score + F.size(F.array_intersect(keys, asked)) * 3.0


def scored(symbols: DataFrame, query: str, allowed: list[str] | None = None, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Symbols with a positive score for ``query``; a blank query gives every symbol score 0.

    ``allowed`` is a list of at most 500 files (an empty one matches nothing). Sections of a page
    take 0.55 of what their page's frontmatter scores if they have a sign of their own.
    """
    rows = symbols
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if allowed is not None:
        if len(allowed) > 500:
            raise ValueError("at most 500 files")
        rows = rows.where(F.col("file_path").isin(*allowed)) if allowed else rows.where(F.lit(False))
    query = query.strip().lower()
    if not query:
        return rows.withColumn("score", F.lit(0.0))
    import re

    words = sorted({w for w in re.split(r"[^A-Za-z0-9]+", query) if len(w) > 1})
    mark = F.col("metadata.markdown")
    front = F.col("metadata.frontmatter")
    pages = symbols.where(front.isNotNull()).select(F.col("cache_key").alias("page_key"), F.col("id").alias("page_id"), frontmatter_score(front, query, words).alias("page_score")).groupBy("page_key", "page_id").agg(F.max("page_score").alias("page_score"))
    inherits = (F.col("cache_key") == F.col("page_key")) & (mark["root_id"] == F.col("page_id")) & (mark["root_id"] != F.col("id"))
    # Each step is a column of its own, so that no step is worked out more than once.
    found = rows.join(pages, inherits, "left").withColumn("own", local_score(query, words)).withColumn("front", frontmatter_score(front, query, words))
    found = found.withColumn("base", F.col("own") + F.col("front")).withColumn("weight", kind_weight(F.col("kind"), F.col("language")))
    local = F.col("own") > 0
    found = found.withColumn("inherited", F.when(local & (F.coalesce("page_score", F.lit(0.0)) > 0), F.col("page_score") * 0.55).otherwise(0.0))
    found = found.withColumn("score", F.when(F.col("base") <= 0, 0.0).otherwise(F.col("base") + F.col("weight")) + F.col("inherited"))
    title = F.lower(F.coalesce(F.try_element_at(front, F.lit("title")), F.lit("")))
    saved = F.coalesce(mark["saved_pct"], F.lit(0))
    if not set(words) & set(PAGE_WORDS):
        found = found.withColumn("score", F.col("score") * F.when((mark["page_root"]) & (saved < 25) & (title != query), 0.5).otherwise(1.0))
    section = (mark["span_kind"] == "section") & ~F.coalesce(mark["page_root"], F.lit(False)) & (saved >= 50)
    found = found.withColumn("score", F.col("score") + F.when(section & (F.col("inherited") > 0) & local, 8.0).otherwise(0.0))
    found = found.withColumn("score", F.col("score") * F.when(in_templates(F.col("file_path")), 0.5).otherwise(1.0))
    return found.where(F.col("score") > 0).drop("page_key", "page_id", "page_score", "own", "front", "base", "weight", "inherited")


def top(symbols: DataFrame, query: str, limit: int = 20, **only) -> DataFrame:
    """The ``limit`` best symbols, ties in the order of the index (ord)."""
    return scored(symbols, query, **only).orderBy(F.col("score").desc(), "ord").limit(limit)
