"""URL allow and block rules as a sorted sweep over reversed-host keys; DataFrame functions only.

A rule is (host, path, action). It fits its host and all subdomains when the url's path starts with the rule's
path. Reversing the labels (``a.example.org`` -> ``org.example.a.``) turns "host or subdomain" into "key starts with
the rule's key", an interval of sorted keys. Intervals of hosts nest, so between two interval ends the stack of
active rules is constant. The sweep range-partitions urls and interval ends together by (key, id), which also
splits a host that holds a third of all rows, and takes for each url the last interval end before it; the end
carries the stack. What a range inherits from the ranges before it is one row per range.

Cases: null url or one without ``://`` has empty host and path and fits no rule; repeated rows are each judged; an
empty table gives an empty result; extra columns are dropped; the longest rule wins, then the longer host, then
the one that sorts first; no rule fits -> rule null and the default verdict. A stack holds the rules of one host
and its parents, so rules per host, not urls, bound its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, staged

#: The rules that the query judges by.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.substr(url, F.length(rest) + 4)
    return F.coalesce(ascii_lower(F.regexp_extract(F.when(rest.isNotNull(), tail), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.regexp_extract(F.when(rest.isNotNull(), tail), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def interval_ends(rules: DataFrame) -> DataFrame:
    """(key, stack): the active rules from this key on, best first. Rules are joined to their parents by hash."""
    own = rules.where("host is not null").select(
        "host", host_key(F.col("host")).alias("hk"), F.coalesce("path", F.lit("")).alias("path"), "action"
    ).distinct()
    own = own.withColumn("rule", F.concat("host", "path"))
    best = F.struct((-F.length("rule")).alias("a"), (-F.length("host")).alias("b"), F.col("rule"), F.col("path"), F.col("action"))
    per_host = own.groupBy("hk").agg(F.collect_list(best).alias("rules"))
    labels = F.split(F.expr("substring(hk, 1, length(hk) - 1)"), r"\.", -1)
    up = per_host.select("hk", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.concat_ws(".", F.slice(labels, 1, n)), F.lit(".")))).alias("pk"))
    chain = up.join(per_host.withColumnRenamed("hk", "pk"), "pk").select("hk", "pk", "rules")
    opens = chain.groupBy("hk").agg(F.array_sort(F.flatten(F.collect_list("rules"))).alias("stack")).select(F.col("hk").alias("key"), "stack")
    closes = (
        chain.groupBy("hk").agg(F.array_sort(F.flatten(F.collect_list(F.when(F.col("pk") != F.col("hk"), F.col("rules"))))).alias("stack"))
        .select(F.concat(F.expr("substring(hk, 1, length(hk) - 1)"), F.lit("/")).alias("key"), "stack")
    )
    return opens.unionByName(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages; see the module's text for the cases."""
    spark = pages.sparkSession
    ends = interval_ends(rules)
    none = F.lit(None).cast(ends.schema["stack"].dataType)
    id_type = pages.schema[id_col].dataType
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u"))
    urls = urls.select("_id", url_host(F.col("_u")).alias("host"), url_path(F.col("_u")).alias("path"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "_id", "host", "path", none.alias("stack"))
    ends = ends.select("key", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("_id"), F.lit("").alias("host"), F.lit("").alias("path"), "stack")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = urls.unionByName(ends).repartitionByRange(n, "key", "kind", "_id", "path").withColumn("pid", F.spark_partition_id())
    ranged = staged(ranged, "urlsweep")  # range bounds are drawn once; both readers below see the same ranges
    last_end = ranged.groupBy("pid").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("own"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = last_end.select("pid", F.last("own", True).over(before).alias("carried"))
    sweep = Window.partitionBy("pid").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = ranged.withColumn("stack", F.last("stack", True).over(sweep)).where("kind = 1").join(carried, "pid")
    active = active.withColumn("stack", F.coalesce("stack", "carried"))
    hit = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    return active.withColumn("hit", F.get(hit, F.lit(0))).select(
        F.col("_id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict")
    )


def rules_frame(spark, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, action string")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


OP2_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hp AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(rhost, rpath, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
  coalesce(max_by(action, length(rhost || rpath)), 'allow') AS verdict
FROM hp LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""
