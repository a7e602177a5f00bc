"""Sources mixed to target shares of all tokens, no document used more often than its cap.

A temperature family leads from the sources' natural token shares s to the targets w: weights
in proportion to s^(1-a) * w^a, which at 1 are the targets themselves. Sources without tokens
have no natural share; they keep their targets at every exponent, and only the rest is tempered.

For each source the exponent is bisected to its repetition limit: the largest at which its cap
still yields its weight. A source whose limit is reached before 1 is short, and what it gives is
its weight at that exponent; the others give their targets. A tempered mix takes for all sources
the one exponent at which none is short, or that of a given entropy. The weights become budgets,
and a budget is realised as full passes over the source and one part of a pass. The part is a
prefix of a permutation of blocks of documents: whole blocks count by their token sums, and only
the one block of a source that the budget ends in is put in order row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from strataloom.llm.tokens import DEFAULT, token_table
from strataloom.runtime import cut

#: Rows of a block of one source on average, and the sources a mix may have at most.
BLOCK_ROWS, MAX_SOURCES = 5_000, 4_096


@dataclass
class Source:
    name: str
    weight: float
    cap: int | None  # None: no limit on repeats
    tokens: int
    documents: int


def weights_at(sources: list[Source], exponent: float) -> list[float]:
    """The family's weights. They sum to what the targets do; sources without weight get none."""
    total = sum(s.tokens for s in sources)
    raw = [(s.tokens / total) ** (1 - exponent) * s.weight**exponent if s.tokens and s.weight > 0 else 0.0 for s in sources]
    whole, held = sum(raw), sum(s.weight for s in sources if s.tokens)
    return [x / whole * held if s.tokens and whole else s.weight if not s.tokens else 0.0 for s, x in zip(sources, raw)]


def limit_exponents(sources: list[Source], steps: int = 60) -> list[float]:
    """For each source the largest exponent at which its cap yields its weight; 1 if it isn't short.

    Along the family a source's weight over its natural share is log-concave, so from 1 down to
    0 it leaves its limit once. All sources are bisected together. A source without tokens but
    with a weight is short at every exponent, hence 0.
    """
    total = sum(s.tokens for s in sources)
    short = [s.cap is not None and s.weight * total > s.cap * s.tokens for s in sources]
    out = [0.0 if x else 1.0 for x in short]
    at = [i for i, s in enumerate(sources) if short[i] and s.tokens]
    live = [s for s in sources if s.tokens and s.weight > 0]
    if not at:
        return out
    held = sum(s.weight for s in live)
    base = np.log(np.array([s.tokens / total for s in live]))
    pull = np.log(np.array([s.weight for s in live])) - base
    own = np.array([math.log(sources[i].tokens / total) for i in at])
    tug = np.array([math.log(sources[i].weight) for i in at]) - own
    most = np.array([sources[i].cap * sources[i].tokens / total for i in at])
    lo, hi = np.zeros(len(at)), np.ones(len(at))
    for _ in range(steps):
        mid = (lo + hi) / 2
        whole = np.exp(base[None, :] + mid[:, None] * pull[None, :]).sum(axis=1)
        kept = np.exp(own + mid * tug) / whole * held <= most
        lo, hi = np.where(kept, mid, lo), np.where(kept, hi, mid)
    for i, a in zip(at, lo):
        out[i] = float(a)
    return out


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def exponent_for(sources: list[Source], target_entropy: float | None = None, steps: int = 60) -> float:
    """The exponent in 0..1 by bisection.

    With ``target_entropy``, the one at which the entropy is nearest to it; else the largest at
    which every source with tokens stays within its cap (0 if none does).
    """
    total = sum(s.tokens for s in sources)

    def kept(a: float) -> bool:
        found = weights_at(sources, a)
        return all(s.cap is None or not s.tokens or w * total <= s.cap * s.tokens * (1 + 1e-12) for s, w in zip(sources, found))

    lo, hi = 0.0, 1.0
    if target_entropy is None:
        if kept(1.0):
            return 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if kept(mid) else (lo, mid)
        return lo
    falling = entropy(weights_at(sources, 1.0)) < entropy(weights_at(sources, 0.0))
    if abs(entropy(weights_at(sources, 1.0)) - target_entropy) < 1e-12:
        return 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = entropy(weights_at(sources, mid)) < target_entropy
        lo, hi = (lo, mid) if below == falling else (mid, hi)
    return (lo + hi) / 2


def target_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, source and n_tokens of the documents whose source has a target."""
    named = targets.where(F.col("source").isNotNull()).select("source").distinct()
    return token_table(documents.join(named, "source", "left_semi"), ["doc_id", "source"], vocabulary)


def source_totals(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: weight (0 if null), max_repeats (null: no limit), tokens and documents."""
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max("max_repeats").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    return wanted.join(held, "source", "left").select("source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))


def collected(totals: DataFrame) -> list[Source]:
    """The targets on the driver; their number is a parameter of the mix and is checked."""
    rows = totals.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    return [Source(r.source, float(r.weight), r.max_repeats, int(r.tokens), int(r.documents)) for r in rows]


def short_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT) -> DataFrame:
    """Sources that fall short of their weight even with every document used as often as allowed:
    those whose repetition limit is reached at an exponent below 1."""
    sources = collected(source_totals(target_documents(documents, targets, vocabulary), targets))
    found = [(s.name,) for s, a in zip(sources, limit_exponents(sources)) if a < 1.0]
    return documents.sparkSession.createDataFrame(found, "source string")


@dataclass
class Mix:
    uses: DataFrame
    shares: DataFrame


def mixed(documents: DataFrame, targets: DataFrame, tempered: bool = False, seed: int = 0, vocabulary: str = DEFAULT) -> Mix:
    """Uses of every document with a target, and what share each source has in the end.

    uses: doc_id, source, n_tokens, uses (0 and more). shares: source, weight, exponent (of the
    mix), limit_exponent (of the source), target_tokens, tokens, documents, actual_tokens, actual_share, repeats, short. The total is
    that of all documents with a target, each counted once. A source that can't reach its
    target within its cap gives every document max_repeats times and is short; the others keep
    their targets. With ``tempered``, the exponent is lowered until no source is short. Null or
    empty texts have no tokens and are used as often as their source's full passes. A null
    weight is 0; null sources and sources without a target aren't used.
    """
    spark = documents.sparkSession
    sized = cut(target_documents(documents, targets, vocabulary))
    sources = collected(source_totals(sized, targets))
    total = sum(s.tokens for s in sources)
    a = exponent_for(sources) if tempered else 1.0
    limits = limit_exponents(sources)
    # A short source gives its weight at its own limit.
    given = [w if tempered or e == 1.0 else weights_at(sources, e)[i] if s.tokens else 0.0 for i, (s, w, e) in enumerate(zip(sources, weights_at(sources, a), limits))]
    plan = []
    for s, w, g, limit in zip(sources, weights_at(sources, a), given, limits):
        budget = g * total if s.tokens else 0.0
        if s.cap is not None:
            # What bisection leaves between its weight and its limit is less than a token.
            budget = float(s.cap * s.tokens) if budget > s.cap * s.tokens - 0.5 else budget
        passes = int(budget // s.tokens) if s.tokens else 0
        blocks = max(1, -(-s.documents // BLOCK_ROWS))
        plan.append((s.name, s.weight, a, w * total, budget, passes, budget - passes * s.tokens, blocks, s.cap, s.tokens, s.documents, limit))
    columns = "source string, weight double, exponent double, target_tokens double, budget double, passes int, rest double, blocks int, cap int, tokens long, documents long, limit_exponent double"
    table = spark.createDataFrame(plan, columns)
    # The plan has a row per target: at most MAX_SOURCES short rows, so it is broadcast.
    placed = sized.join(F.broadcast(table.select("source", "passes", "rest", "blocks")), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    sums = placed.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("in_block"))
    along = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    run = sums.withColumn("before", F.sum("in_block").over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    inside = run.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_block") > F.col("rest")))
    # One block per source ends its budget.
    edge = inside.groupBy("source").agg(F.min_by("block", "before").alias("edge"), F.min("before").alias("edge_before"))
    whole = run.where(F.col("before") + F.col("in_block") <= F.col("rest")).select("source", "block", F.lit(1).alias("in_full"))
    marked = placed.join(whole, ["source", "block"], "left").join(F.broadcast(edge), "source", "left")
    rows = marked.where(F.col("block") == F.col("edge"))
    order = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.col("edge_before") + F.sum("n_tokens").over(order)
    # The document that crosses the budget is in if that comes nearer to it.
    near = F.col("rest") - (so_far - F.col("n_tokens")) > so_far - F.col("rest")
    last = rows.withColumn("extra", ((so_far <= F.col("rest")) | ((so_far - F.col("n_tokens") < F.col("rest")) & near)).cast("int"))
    other = marked.where(~F.col("block").eqNullSafe(F.col("edge"))).withColumn("extra", F.coalesce("in_full", F.lit(0)))
    cap = F.broadcast(table.select("source", "cap"))
    uses = last.unionByName(other).join(cap, "source").select("doc_id", "source", "n_tokens", F.least(F.col("passes") + F.col("extra"), F.coalesce("cap", F.col("passes") + F.col("extra"))).alias("uses"))
    held = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"), F.max("uses").alias("repeats"))
    grand = held.agg(F.sum("actual_tokens")).scalar()
    shares = table.join(held, "source", "left").select(
        "source", "weight", "exponent", "limit_exponent", "target_tokens", "tokens", "documents", F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
        F.coalesce(F.col("actual_tokens") / grand, F.lit(0.0)).alias("actual_share"), F.coalesce("repeats", F.lit(0)).alias("repeats"), (F.col("target_tokens") > F.col("budget") * (1 + 1e-12)).alias("short"),
    )
    return Mix(uses, shares)
