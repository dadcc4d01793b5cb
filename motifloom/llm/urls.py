"""URL filter: listed rules first, then rules mined from labelled pages.

A listed rule names a host and the start of a path; it fits the host and its
subdomains, and the longest that fits gives the verdict. Pages that none fits are
judged by association rules: FP-growth finds the combinations of URL tokens (host
labels, host endings, path words, query keys) that occur with a bad label, and
those with enough support, confidence and lift, and no shorter rule that is as
sure, are kept. Each is filed under its rarest token; a URL is looked up by its
tokens and blocked if all tokens of a rule so found are its own. Distinct URLs are
judged once, and the verdicts joined to the pages.

Edge cases: a null URL, or one without ://, has an empty host and path, fits no
listed rule, and is judged by its tokens if any; without labels nothing is mined
and every such page is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Host, path, verdict.
LISTED = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_BAD = "=bad"


@dataclass(frozen=True)
class Settings:
    support: float = 0.001  # of the labelled pages
    least: int = 20  # labelled pages that a rule must match with a bad label
    confidence: float = 0.6
    lift: float = 1.5
    broadcast_rules: int = 20_000  # beyond so many the look-up shuffles instead


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.expr("substring(rest_, length(host_) + 1)")
    out = pages.withColumn("rest_", F.coalesce(after, F.lit(""))).withColumn("host_", F.regexp_extract("rest_", "^[^/?#]*", 0))
    out = out.withColumn("path", F.regexp_extract(rest, "^[^?#]*", 0))
    lowered = F.translate("host_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return out.withColumn("host", lowered).drop("rest_", "host_")


def listed(rules=LISTED) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def fits(host: str, path: str) -> Column:
        own = (F.col("host") == host) | F.col("host").endswith("." + host)
        return own & F.col("path").startswith(path)

    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, v in reversed(ordered):
        name = F.when(fits(host, path), host + path).otherwise(name)
        verdict = F.when(fits(host, path), v).otherwise(verdict)
    return name, verdict


def tokens(url: str = "url") -> Column:
    """The distinct tokens of a URL; numbers are not tokens."""
    whole = F.lower(F.coalesce(F.col(url), F.lit("")))
    after = F.regexp_replace(whole, "^.*?://", "")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(after, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    words = F.filter(F.split(path, "[^\\p{L}\\p{N}]+"), lambda t: t.rlike(r"\p{L}"))
    keys = F.transform(F.filter(F.split(query, "&"), lambda t: t.rlike("^[^=]")), lambda t: F.regexp_extract(t, "^[^=]*", 0))
    parts = F.concat(
        F.transform(F.filter(labels, lambda t: t != ""), lambda t: F.concat(F.lit("h:"), t)),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda t: F.concat(F.lit("p:"), t)),
        F.transform(keys, lambda t: F.concat(F.lit("q:"), t)),
    )
    return F.array_distinct(parts)


def mined_rules(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """anchor, needs (the other tokens too), confidence, support of each kept rule. labelled: url, bad (boolean)."""
    items = labelled.select(F.when(F.col("bad"), F.array_append(tokens(), _BAD)).otherwise(tokens()).alias("items"))
    items = saved(items.where(F.size("items") > 0), "url-items")
    schema = "anchor string, needs array<string>, confidence double, support double"
    n = items.count()
    if n < settings.least:
        return items.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=max(settings.support, settings.least / n), minConfidence=settings.confidence).fit(items)
    found = model.associationRules.where((F.col("consequent")[0] == _BAD) & (F.col("lift") >= settings.lift))
    rules = found.select(F.array_sort("antecedent").alias("needs"), "confidence", "support")
    shorter = rules.select(F.col("needs").alias("s_needs"), F.col("confidence").alias("s_confidence"))
    part = rules.select("needs", "confidence", F.explode("needs").alias("left_out"))
    part = part.select("needs", "confidence", F.array_except("needs", F.array("left_out")).alias("s_needs"))
    beaten = part.join(shorter, "s_needs").where("s_confidence >= confidence").select("needs").distinct()
    rules = rules.join(beaten, "needs", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("anchor"), "freq")
    ranked = rules.select("needs", "confidence", "support", F.explode("needs").alias("anchor")).join(single, "anchor")
    anchor = ranked.groupBy("needs", "confidence", "support").agg(F.min_by("anchor", F.struct("freq", "anchor")).alias("anchor"))
    return anchor.select("anchor", "needs", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The distinct urls that a rule matches."""
    if rules.count() <= settings.broadcast_rules:
        rules = F.broadcast(rules)
    own = urls.distinct().select("url", tokens().alias("own"))
    hits = own.select("url", "own", F.explode("own").alias("anchor")).join(rules, "anchor")
    return hits.where(F.forall("needs", lambda t: F.array_contains("own", t))).select("url").distinct()


def judge(pages: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. pages: page_id, url."""
    rules = saved(mined_rules(labelled, settings), "url-rules")
    split = with_host_path(pages.select("page_id", "url"))
    name, verdict = listed()
    split = split.withColumns({"rule": name, "listed_": verdict})
    open_urls = split.where("listed_ is null and url is not null").select("url")
    hits = matched(open_urls, rules, settings).withColumn("hit_", F.lit(True))
    out = split.join(hits, "url", "left")
    verdict = F.coalesce("listed_", F.when(F.col("hit_"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    return judge(pages, pages.join(bad, "page_id").select("url", "bad"))
