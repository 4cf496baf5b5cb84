"""robots.txt as relations: groups by a running sum, rules with compiled patterns, longest match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import trimmed


def compiled(pattern: Column) -> Column:
    """The pattern as a regular expression: * is anything, $ at the end anchors, the rest is literal."""
    literal = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    starred = F.regexp_replace(literal, r"\*", ".*")
    return F.concat(F.lit("^"), F.when(pattern.endswith("$"), F.regexp_replace(starred, r"\\\$$", "\\$")).otherwise(starred))


def directives(robots: DataFrame) -> DataFrame:
    """(host, text) to the directives of the groups that count for nobody yet: host, ord, grp, key, value."""
    lines = robots.select("host", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "line"))
    lines = lines.withColumn("line", trimmed(F.split(trimmed(F.col("line")), "#")[0])).filter("line <> ''")
    rows = lines.select("host", "ord", F.lower(trimmed(F.split("line", ":")[0])).alias("key"), trimmed(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    order = Window.partitionBy("host").orderBy("ord")
    agent = F.col("key") == "user-agent"
    starts = agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    return rows.withColumn("grp", F.sum(starts.cast("int")).over(order)).filter("grp > 0")


def parsed(robots: DataFrame, user_agent: str) -> tuple[DataFrame, DataFrame]:
    """Rules (host, ord, allow, pattern, regex) and delays (host, crawl_delay) of the groups that name the agent, else of those for *."""
    rows = directives(robots)
    agents = rows.filter("key = 'user-agent'").withColumn("agent", F.lower("value"))
    named = (F.col("agent") != "") & (F.col("agent") != "*") & F.contains(F.lit(user_agent.lower()), F.col("agent"))
    groups = agents.groupBy("host", "grp").agg(F.bool_or(named).alias("named"), F.bool_or(F.col("agent") == "*").alias("any"))
    groups = groups.withColumn("some", F.bool_or("named").over(Window.partitionBy("host"))).filter("case when some then named else any end").select("host", "grp")
    mine = rows.join(groups, ["host", "grp"])
    rules = mine.filter("key in ('allow', 'disallow') and value <> ''").select("host", "ord", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"), compiled(F.col("value")).alias("regex"))
    number = F.expr("try_cast(regexp_extract(value, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)', 0) as double)")
    delays = mine.filter("key = 'crawl-delay'").withColumn("d", number).filter("d > 0").groupBy("host").agg(F.max("d").alias("crawl_delay"))
    return rules, delays


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with host, pathname) with allowed: of the host's rules that match the path the longest wins, Allow wins ties.

    The rules of a host are gathered to one array, so that a URL meets them in one row however many match."""
    by_host = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", "regex")).alias("rules"))
    hits = F.filter("rules", lambda r: F.rlike(F.col("pathname"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"], r["allow"])))
    return urls.join(by_host, F.col("host") == F.col("rule_host"), "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rule_host", "rules")


def effective_delay(base_ms: Column, crawl_delay_s: Column) -> Column:
    return F.greatest(base_ms.cast("double"), F.coalesce(crawl_delay_s * 1000, base_ms.cast("double")))
