"""Anchors of a question: the symbols and pages that its rarer terms point at."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataloom.functions.text import ANCHOR_STOP_WORDS, folded, in_templates, tokens

MAX_TERMS = 32
# What a term's hit weighs, by where it is.
FIELD_WEIGHTS = {"file_basename": 8.0, "file_path": 3.0, "symbol_name": 7.0, "qualified_name": 5.0, "signature": 3.0, "summary": 2.0, "docstring": 1.5, "keywords": 4.0}
HIGH_SIGNAL = ("file_basename", "symbol_name", "qualified_name")
FRONT_WEIGHTS = {"title": 7.0, "tags": 5.0, "description": 4.0, "source": 4.0}


def question_terms(question: str) -> list[str]:
    """Distinct terms of a question in order, without stop words, at most 32."""

    def normal(t: str) -> str:
        if len(t) > 4 and t.endswith("ies"):
            return t[:-3] + "y"
        return t[:-1] if len(t) > 4 and t.endswith("s") and not t.endswith(("ss", "us", "is")) else t

    stop = {*ANCHOR_STOP_WORDS}
    found = [normal(t) for t in re.findall(r"[a-z0-9]+", question.casefold()) if t not in stop]
    return list(dict.fromkeys(t for t in found if len(t) >= 2 and t not in stop))[:MAX_TERMS]


def specificity(frequency: Column, corpus: Column) -> Column:
    """1 + ln((N + 1) / (df + 1))."""
    return 1 + F.log((corpus + 1) / (frequency + 1))


def document_frequency(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """In how many documents each term is; a document counts once however often it has it."""
    each = texts.select(key, F.explode(F.array_distinct(tokens(text))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("document_frequency"))


def _mentions(text: Column, terms: list[str]) -> Column:
    """Whether a text may hold one of the terms: what normalises to a term has it, or its plural in -ies, in it."""
    forms = sorted({f for t in terms for f in (t, t[:-1] + "ies" if t.endswith("y") else t)})
    return folded(text).rlike("|".join(forms)) if forms else F.lit(False)


def fields(symbols: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """A row for each searched field of each symbol: ord, unit, scope, weight and tokens.

    With ``terms`` only fields that may hold one of them are cut into tokens and given.
    """
    base = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    texts = {"file_basename": base, "file_path": F.col("file_path"), "symbol_name": F.col("name"), "qualified_name": F.col("qualified_name"), "signature": F.col("signature"), "summary": F.col("summary"), "docstring": F.col("docstring"), "keywords": F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")}
    plain = F.array(*(F.struct(F.lit(s).alias("scope"), F.lit(FIELD_WEIGHTS[s]).alias("weight"), F.coalesce(t, F.lit("")).alias("text")) for s, t in texts.items()))
    weight = lambda k: F.coalesce(*(F.when(k == n, F.lit(w)) for n, w in FRONT_WEIGHTS.items()), F.lit(3.0))
    front = F.transform(F.map_entries(F.coalesce("metadata.frontmatter", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit("page_frontmatter."), e["key"]).alias("scope"), weight(e["key"]).alias("weight"), F.coalesce(e["value"], F.lit("")).alias("text")))
    unit = F.when(F.col("language") == "markdown", F.concat_ws("::", "cache_key", "file_path")).otherwise(F.concat_ws("::", "cache_key", "id"))
    rows = symbols.where(~in_templates(F.col("file_path"))).select("ord", "id", unit.alias("unit"), F.explode(F.concat(plain, front)).alias("f"))
    if terms is not None:
        rows = rows.where(_mentions(F.col("f.text"), terms))
    return rows.select("ord", "id", "unit", F.col("f.scope").alias("scope"), F.col("f.weight").alias("weight"), tokens(F.col("f.text")).alias("tokens"))


def cap(units: int, wanted: int) -> int:
    """How many anchors may be given: a tenth of the units, one of fewer than eleven."""
    return min(wanted, 1 if units < 11 else max(1, (units - 1) // 10))


def capped(units: Column, wanted: int) -> Column:
    """:func:`cap` of a number of units that is a column."""
    return F.least(F.lit(wanted), F.when(units < 11, 1).otherwise(F.greatest(F.lit(1), F.floor((units - 1) / 10))))


def inferred(symbols: DataFrame, question: str, most: int = 10) -> DataFrame:
    """The best units for a question, with the best symbol of each.

    Columns: rank, unit, id, score, matched_terms. A question without terms has no anchors.
    Document frequencies count units. Only fields that a term hits are aggregated.
    """
    terms = question_terms(question)
    asked = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    all_fields = fields(symbols, terms)
    hits = all_fields.withColumn("hits", F.array_intersect("tokens", asked)).where(F.size("hits") > 0)
    each = hits.withColumn("term", F.explode("hits"))
    sizes = symbols.where(~in_templates(F.col("file_path"))).select(F.when(F.col("language") == "markdown", F.concat_ws("::", "cache_key", "file_path")).otherwise(F.concat_ws("::", "cache_key", "id")).alias("unit")).distinct()
    corpus = sizes.agg(F.count("*")).scalar()
    frequency = each.select("unit", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    covered = F.size("hits") / F.greatest(F.lit(1), F.size(F.array_distinct("tokens")))
    density = 0.35 + 0.65 * covered * covered
    # A row per question term: at most 32, so it is broadcast.
    weighed = each.join(F.broadcast(frequency), "term").withColumn("part", F.col("weight") * specificity(F.col("df"), corpus) * density)
    per_term = weighed.groupBy("unit", "ord", "id", "term").agg(F.max("part").alias("part"))
    pairs = list(zip(terms, terms[1:]))
    high = F.col("scope").isin(*HIGH_SIGNAL, "page_frontmatter.title", "page_frontmatter.tags")
    # A phrase is two terms of the question that follow each other in a field as well.
    at = F.col("tokens")
    follows = F.exists(F.arrays_zip(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))).alias("a"), F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]).isin(*(f"{a} {b}" for a, b in pairs)) if pairs else F.lit(False))
    bonus = hits.groupBy("ord").agg(F.max(F.when(high & follows, F.col("weight") * 2).otherwise(0.0)).alias("bonus"), F.max(high.cast("int")).alias("high"))
    summed = per_term.groupBy("unit", "ord", "id").agg(F.sort_array(F.collect_list("part"), asc=False).alias("parts"), F.count("*").alias("matched"), F.sort_array(F.collect_set("term")).alias("matched_terms")).join(bonus, "ord")
    strongest = F.aggregate(F.slice("parts", 1, 4), F.lit(0.0), lambda a, b: a + b)
    coverage = F.least(F.col("matched"), F.lit(4)) / F.lit(max(1, len(terms)))
    score = (strongest + F.col("bonus")) * (1.0 + 0.25 * coverage)
    kept = summed.where((F.col("high") == 1) | (F.col("matched") >= 2)).withColumn("score", score)
    best = Window.partitionBy("unit").orderBy(F.col("score").desc(), "id")
    of_unit = kept.withColumn("n", F.row_number().over(best)).where("n = 1")
    given = of_unit.orderBy(F.col("score").desc(), "id").limit(most)
    ranked = given.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))).withColumn("most", capped(corpus, most)).where(F.col("rank") <= F.col("most"))
    return ranked.select("rank", "unit", "id", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("matched_terms"))
