"""A site derived from the star schema: home, regions, nations, suppliers and customers, orders, parts, linked along foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "https://shop.example.com"
HOME = f"{SITE}/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(kind: str, key: str):
    return F.concat(F.lit(f"{SITE}/{kind}/"), F.col(key).cast("string"))


def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_url, ord, abs_url, kind): page links along foreign keys, ordered by key."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda rows, src, key, kind, own: rows.select(src.alias("src_url"), F.col(own).cast("long").alias("ord"), address(kind, key).alias("abs_url"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    items = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    parts = [
        edge(t("region").select("r_regionkey"), F.lit(HOME), "r_regionkey", "region", "r_regionkey"),
        edge(t("nation").select("n_nationkey", "n_regionkey"), address("region", "n_regionkey"), "n_nationkey", "nation", "n_nationkey"),
        edge(t("supplier").select("s_suppkey", "s_nationkey"), address("nation", "s_nationkey"), "s_suppkey", "supplier", "s_suppkey"),
        edge(t("customer").select("c_custkey", "c_nationkey").withColumn("k", F.col("c_custkey") + 10_000_000), address("nation", "c_nationkey"), "c_custkey", "customer", "k"),
        edge(orders, address("customer", "o_custkey"), "o_orderkey", "order", "o_orderkey"),
        edge(items, address("order", "l_orderkey"), "l_partkey", "part", "l_partkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("kind", F.lit("page"))


def site_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, http_status, content_type, size, challenge, error, shell, rendered) of every page of the site."""
    t = lambda name: table(spark, sf_dir, name)

    def pages(rows: DataFrame, kind: str, key: str, status="200", ctype="'text/html'", challenge="cast(null as string)", error="cast(null as string)", size="1000", shell="false") -> DataFrame:
        made = {"http_status": f"cast({status} as int)", "content_type": ctype, "size": f"cast({size} as bigint)", "challenge": challenge, "error": error, "shell": shell, "rendered": "false"}
        return rows.select(address(kind, key).alias("url"), *(F.expr(e).alias(n) for n, e in made.items()))

    home = spark.createDataFrame([(HOME, 200, "text/html; charset=utf-8", 1000)], "url string, http_status int, content_type string, size long").selectExpr("*", "cast(null as string) challenge", "cast(null as string) error", "false shell", "false rendered")
    rows = [
        pages(t("region").select("r_regionkey"), "region", "r_regionkey"),
        pages(t("nation").select("n_nationkey"), "nation", "n_nationkey"),
        pages(t("supplier").select("s_suppkey", "s_acctbal"), "supplier", "s_suppkey", challenge="case when s_acctbal < 0 then 'cloudflare' end"),
        pages(t("customer").select("c_custkey", "c_acctbal"), "customer", "c_custkey", status="case when c_acctbal < -500 then 404 else 200 end", size="1000 + c_custkey % 100"),
        pages(t("orders").select("o_orderkey"), "order", "o_orderkey", error="case when o_orderkey % 50 = 7 then 'timeout' end", size="2000 + o_orderkey % 1000"),
        pages(t("part").select("p_partkey", "p_size"), "part", "p_partkey", ctype="case when p_size > 40 then 'application/pdf' else 'text/html' end", size="100 * p_size"),
    ]
    for r in rows:
        home = home.unionByName(r)
    return home


def robots(spark: SparkSession) -> DataFrame:
    """The site's robots.txt."""
    text = "User-agent: *\nDisallow: /customer/*3$\nDisallow: /part/\nAllow: /part/*1\nCrawl-delay: 2\n"
    return spark.createDataFrame([("shop.example.com", text)], "host string, text string")
