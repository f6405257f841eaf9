"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A rule is a string ``host/path-prefix`` (``example.org/es/``, ``net/``) with an action, ``allow`` or
``block``. It fits its host and all subdomains, where the url's path starts with the rule's path.
Every distinct url is expanded into ``last labels of the host + start of the path`` for each pair
(number of labels, path length) that occurs among the rules, which is all that can match. The
expressions meet the rules on the first 32 bits of their SHA-256; the full digest then confirms, and
the longest fitting rule decides.

Scale: verdicts are found once per distinct url (partial aggregation comes first), the join back to
the rows is an ordinary equi-join that AQE splits when one url is hot, and the rules are broadcast
only if their own size is below Spark's threshold. The driver gathers the distinct (labels, length)
pairs of the rules alone; those are bounded by host and url syntax, not by the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm._tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8

RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(rule, action) -> one row per distinct rule with its digest; of two actions for one rule, block holds.

    Rules that are null, or have no host, fit nothing and are left out."""
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    return (
        rules.where(F.col("rule").isNotNull() & (host != ""))
        .groupBy("rule").agg(F.max("action").alias("action"))  # 'block' > 'allow'
        .select(
            "rule", "action", F.concat(host, path).alias("expression"),
            F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("path_length"), F.length(host).alias("host_length"),
        )
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with columns host, path, rule and verdict; one row out for each row in.

    The longest fitting rule gives the verdict (ties: longer host, then block, then the smaller
    rule); where none fits, rule is null and verdict is ``default``. A url that is null or has no
    ``://`` has an empty host and path and fits no rule. Repeated rows are each judged; an empty
    table gives an empty result. Columns of pages called host, path, rule or verdict are replaced.
    """
    ready = prepare_rules(rules)
    shapes = [(r["labels"], r["path_length"]) for r in ready.select("labels", "path_length").distinct().collect()]
    pages = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    parsed = {"host": url_host(F.col(url)), "path": url_path(F.col(url))}
    if not shapes:
        return pages.withColumns(parsed | {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths: dict[int, list[int]] = {}
    for n, k in sorted(shapes):
        lengths.setdefault(n, []).append(k)
    known = F.array(*(F.struct(F.lit(n).alias("labels"), F.array(*map(F.lit, ks)).alias("lengths")) for n, ks in lengths.items()))
    # only what the host and the path are long enough for is made a row
    fits = F.filter(known, lambda s: s["labels"] <= F.size(F.split("host", r"\.")))
    shape = F.flatten(F.transform(fits, lambda s: F.transform(F.filter(s["lengths"], lambda k: k <= F.length("path")), lambda k: F.struct(s["labels"].alias("labels"), k.alias("length")))))
    expressions = (
        pages.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).groupBy("_url").agg(F.lit(1).alias("_one"))
        .select("_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
        .select("*", F.explode(shape).alias("shape"))
        .select("_url", F.expr("concat(substring_index(host, '.', -shape.labels), substring(path, 1, shape.length))").alias("expression"))
        .select("_url", F.sha2("expression", 256).alias("url_digest"))
        .withColumn("short", F.substring("url_digest", 1, PREFIX_HEX))
    )
    order = F.struct(  # the least is the best
        (-F.length("expression")).alias("length"), (-F.col("host_length")).alias("host_length"), (F.col("action") != "block").alias("allow"), F.col("rule"), F.col("action"),
    )
    verdicts = (
        expressions.join(ready, "short")
        .where(F.col("url_digest") == F.col("digest"))
        .groupBy("_url").agg(F.min(order).alias("best"))
        .select("_url", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    free = "_url"
    while free in pages.columns:
        free += "_"
    judged = pages.withColumns(parsed).join(verdicts.withColumnRenamed("_url", free), F.col(url) == F.col(free), "left").drop(free)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages by the five stated rules. A null url and one without ``://`` have an empty host and path and the
    default verdict, allow; repeated rows are judged each, ties of rules as in filter_urls; an empty table gives an empty result."""
    rules = spark.createDataFrame(RULES, "rule string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rules(rule, action) AS (VALUES {rules}),
parts AS (
  SELECT rule, action, regexp_extract(rule, '^([^/]*)', 1) AS rhost, regexp_extract(rule, '^[^/]*(.*)$', 1) AS rpath FROM rules),
judged AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ranked AS (
  SELECT j.*, p.rule, p.action,
    row_number() OVER (PARTITION BY j.n ORDER BY length(p.rule) DESC NULLS LAST, length(p.rhost) DESC) AS place
  FROM judged j LEFT JOIN parts p
    ON (j.host = p.rhost OR ends_with(j.host, '.' || p.rhost)) AND starts_with(j.path, p.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM ranked WHERE place = 1
""".format(rules=", ".join(f"('{r}', '{a}')" for r, a in RULES), upper=UPPER, lower=LOWER)
