"""Usage of the index: savings, findings, and gets related to the search before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataloom.functions.times import iso, within_days

#: Seconds for which a search may explain a later get.
SEARCH_TTL = 300


def from_events(events: DataFrame) -> DataFrame:
    """The events table as telemetry: views and purchases are gets (of code and of pages),
    clicks are searches, errors misses and signups outlines."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    get = kind.isin("view", "purchase")
    symbol_bytes = F.when(get, F.floor(F.col("value") * 10))
    return events.select(
        "event_id", "ts", F.col("user_id").alias("session"), F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string")).alias("repo"),
        F.when(get, "get").when(kind == "click", "search").when(kind == "error", "miss").otherwise("outline").alias("event"),
        F.when(kind == "purchase", "markdown").when(get, F.when(k % 2 == 0, "python").otherwise("go")).alias("language"),
        F.when(get, F.concat(F.lit("f"), (k % 20).cast("string"), F.lit(".x::s"), k.cast("string"))).alias("symbol_id"),
        F.when(get, F.when(k % 3 == 0, "function").otherwise("method")).alias("kind"), symbol_bytes.alias("symbol_bytes"), F.when(get, symbol_bytes + k * 7).alias("file_bytes"),
        F.when(get & (k % 5 != 0), k % 10).alias("search_rank"), F.when(get & (k % 4 != 0), k).alias("search_id"), F.when(kind.isin("error", "click"), F.concat(F.lit("q"), k.cast("string"))).alias("query"),
        F.when(kind == "click", F.col("value") > 5.0).alias("has_results"),
        F.when(kind == "signup", F.when(k % 3 == 0, F.array(F.lit("markdown"))).when(k % 3 == 1, F.array(F.lit("python"), F.lit("markdown")))).alias("languages"),
    )


def _savings(gets: DataFrame, *by: str) -> DataFrame:
    """Gets, saved bytes, tokens and percent and the last time, per group."""
    rows = gets.groupBy(*by).agg(F.count("*").alias("gets"), F.sum("symbol_bytes").alias("symbol_bytes"), F.sum("file_bytes").alias("file_bytes"), F.max("ts").alias("last_ts"))
    saved = F.greatest(F.col("file_bytes") - F.col("symbol_bytes"), F.lit(0))
    return rows.select(*by, "gets", "symbol_bytes", saved.alias("saved_bytes"), F.floor(saved / 4).alias("saved_tokens"), F.when(F.col("file_bytes") > 0, F.floor(saved / F.col("file_bytes") * 100)).otherwise(F.lit(0)).alias("saved_pct"), "last_ts")


def lane() -> Column:
    return F.when(F.col("language") == "markdown", "docs").otherwise("code")


def stats_lanes(log: DataFrame) -> DataFrame:
    """Savings of the lanes code and docs and of both; null lane is the total."""
    return _savings_sets(log.where("event = 'get'").withColumn("lane", lane()), ["lane"])


def stats_by_group(log: DataFrame) -> DataFrame:
    """Savings per repo and lane, per repo, per lane and in total, by one pass of grouping sets."""
    return _savings_sets(log.where("event = 'get'").withColumn("lane", lane()), ["repo", "lane"])


def _savings_sets(gets: DataFrame, by: list[str]) -> DataFrame:
    rows = gets.cube(*by).agg(F.count("*").alias("gets"), F.sum("symbol_bytes").alias("symbol_bytes"), F.sum("file_bytes").alias("file_bytes"), F.max("ts").alias("last_ts"))
    saved = F.greatest(F.col("file_bytes") - F.col("symbol_bytes"), F.lit(0))
    return rows.select(*by, "gets", "symbol_bytes", saved.alias("saved_bytes"), F.floor(saved / 4).alias("saved_tokens"), F.when(F.col("file_bytes") > 0, F.floor(saved / F.col("file_bytes") * 100)).otherwise(F.lit(0)).alias("saved_pct"), "last_ts")


def outline_lanes(log: DataFrame) -> DataFrame:
    """Outlines per lane: one counts for each lane that it surfaced, and for code if none was noted."""
    listed = F.coalesce("languages", F.array().cast("array<string>"))
    code = F.exists(listed, lambda x: x != "markdown") | (F.size(listed) == 0)
    lanes = F.array_compact(F.array(F.when(code, F.lit("code")), F.when(F.array_contains(listed, "markdown"), F.lit("docs"))))
    return log.where("event = 'outline'").select(F.explode(lanes).alias("lane")).groupBy("lane").agg(F.count("*").alias("outlines"))


def since(log: DataFrame, days: int | None, now: Column | None = None) -> DataFrame:
    """Events of the last ``days`` before ``now`` (the present if not given); all with None."""
    return log.where(within_days(F.col("ts"), days, F.current_timestamp() if now is None else now))


def stats_by_file(log: DataFrame) -> DataFrame:
    file = F.concat_ws("/", "repo", F.substring_index("symbol_id", "::", 1))
    return _savings(log.where("event = 'get'").withColumn("file", file), "file")


def search_misses(log: DataFrame) -> DataFrame:
    """Queries that found nothing and how often."""
    return log.where("event = 'miss' AND query IS NOT NULL AND query <> ''").groupBy("query").agg(F.count("*").alias("misses"))


def correlated(log: DataFrame) -> DataFrame:
    """Gets that name a search which is either unknown here or of the same repo.

    A search id is used by a session; the searches' side has one row for each.
    """
    searches = log.where("event = 'search'").groupBy(F.col("event_id").alias("s_id")).agg(F.max("repo").alias("s_repo"))
    gets = log.where("event = 'get' AND search_id IS NOT NULL")
    return gets.join(searches, gets.search_id == searches.s_id, "left").where(F.col("s_repo").isNull() | (F.col("s_repo") == F.col("repo"))).drop("s_id", "s_repo")


def blind_spots(log: DataFrame) -> DataFrame:
    """One row if at least 15 % of related gets fetch what the search before didn't return."""
    seen = correlated(log).agg(F.count("*").alias("correlated_gets"), F.sum(F.col("search_rank").isNull().cast("long")).alias("blind_spots"))
    return seen.where((F.col("correlated_gets") > 0) & (F.col("blind_spots") >= 0.15 * F.col("correlated_gets")))


def poor_ranking(log: DataFrame) -> DataFrame:
    """One row if at least 20 % of related gets with a rank have rank 3 (from 0) or worse."""
    seen = correlated(log).where("search_rank IS NOT NULL").agg(F.count("*").alias("ranked_gets"), F.sum((F.col("search_rank") >= 3).cast("long")).alias("poor_ranked"), F.sum("search_rank").alias("rank_sum"))
    return seen.where((F.col("ranked_gets") > 0) & (F.col("poor_ranked") >= 0.2 * F.col("ranked_gets")))


def dead_kinds(log: DataFrame, symbols: DataFrame) -> DataFrame:
    """Kinds of which more than 50 symbols are indexed and none was ever fetched."""
    fetched = log.where("event = 'get' AND kind IS NOT NULL").select("kind").distinct()
    indexed = symbols.where("kind <> ''").groupBy("kind").agg(F.count("*").alias("indexed_count")).where("indexed_count > 50")
    return indexed.join(fetched, "kind", "left_anti")


def poor_extraction(log: DataFrame) -> DataFrame:
    """Languages whose gets save less than half of their files' bytes."""
    seen = log.where("event = 'get' AND language IS NOT NULL").groupBy("language").agg(F.sum("symbol_bytes").alias("symbol_bytes"), F.sum("file_bytes").alias("file_bytes"))
    return seen.where((F.col("file_bytes") > 0) & (2 * (F.col("file_bytes") - F.col("symbol_bytes")) < F.col("file_bytes")))


def hotspots(log: DataFrame, most: int = 10) -> DataFrame:
    """The ten symbols fetched most often, three times at least; ties by symbol."""
    seen = log.where("event = 'get' AND symbol_id IS NOT NULL").groupBy("symbol_id").agg(F.count("*").alias("fetch_count")).where("fetch_count >= 3")
    return seen.orderBy(F.col("fetch_count").desc(), "symbol_id").limit(most)


def summary(log: DataFrame) -> DataFrame:
    """Counts of events, when the first and the last were (also in ISO form), the rate of misses
    and the share of gets that are related to a search."""
    count = lambda e: F.count(F.when(F.col("event") == e, 1))
    rows = log.agg(count("get").alias("gets"), count("search").alias("searches"), count("miss").alias("misses"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    total = F.col("gets") + F.col("misses")
    related = correlated(log).agg(F.count("*").alias("correlated"))
    rate = F.round(F.when(total > 0, F.col("misses") / total).otherwise(0.0), 3)
    share = F.round(F.when(F.col("gets") > 0, F.col("correlated") / F.col("gets")).otherwise(0.0), 3)
    # Both sides are one row.
    both = rows.withColumn("one", F.lit(1)).join(related.withColumn("one", F.lit(1)), "one").drop("one")
    return both.select("gets", "searches", "misses", "first_ts", "last_ts", iso(F.col("first_ts")).alias("period_from"), iso(F.col("last_ts")).alias("period_to"), rate.alias("miss_rate"), share.alias("correlated_pct"))


def findings(log: DataFrame, symbols: DataFrame) -> DataFrame:
    """All findings in one table: finding, subject and count; what can't be found gives no row."""
    none = F.lit(None).cast("string")
    row = lambda df, name, subject, count: df.select(F.lit(name).alias("finding"), subject.alias("subject"), count.cast("long").alias("count"))
    parts = [
        row(search_misses(log), "search_miss", F.col("query"), F.col("misses")),
        row(blind_spots(log), "search_blind_spot", none, F.col("blind_spots")),
        row(poor_ranking(log), "search_ranking_poor", none, F.col("poor_ranked")),
        row(dead_kinds(log, symbols), "kind_dead_weight", F.col("kind"), F.col("indexed_count")),
        row(poor_extraction(log), "poor_extraction", F.col("language"), F.col("symbol_bytes")),
        row(hotspots(log), "refetch_hotspot", F.col("symbol_id"), F.col("fetch_count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_search(log: DataFrame, ttl: int = SEARCH_TTL) -> DataFrame:
    """Each get with the latest search with results of its session, ``ttl`` seconds old at most.

    It is kept only if it is of the get's repo. Both sides are put into bins of ``ttl`` seconds,
    a search also into the next one, so that the window of a busy session is cut into bins.
    A search at the get's own time counts; of several at one time the greatest event_id does.
    """
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (ttl * 1_000_000))
    gets = log.where("event = 'get'").select("event_id", "ts", "session", "repo", seconds.alias("bin"), F.lit(1).alias("is_get"))
    searches = log.where("event = 'search' AND has_results").select("event_id", "ts", "session", "repo", F.explode(F.array(seconds, seconds + 1)).alias("bin"), F.lit(0).alias("is_get"))
    both = gets.unionByName(searches)
    past = Window.partitionBy("session", "bin").orderBy("ts", "is_get", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.col("is_get") == 0, F.struct("event_id", "ts", "repo")), ignorenulls=True).over(past)
    joined = both.withColumn("found", found).where("is_get = 1")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("found.ts").cast("timestamp"))
    fits = (age <= ttl * 1_000_000) & (F.col("found.repo") == F.col("repo"))
    return joined.select("event_id", F.when(fits, F.col("found.event_id")).alias("search_event_id"))
