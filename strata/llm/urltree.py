"""URL filters: fixed rules, and a path-template tree with labelled purity, in built-in
functions only.

The tree grows level by level over all pages. At each level the children of a node (host and
template so far) are its next path segments with their page counts and labelled counts. A
segment stays literal if it has :data:`MIN_PAGES`, whatever its share of the node, and its rate of bad labels differs from
that of its siblings (two-proportion test); all others are generalised: rare segments are
variable, and statistically similar branches are merged into one wildcard. A level is two
grouped counts and a join with the few literal children; page rows are never gathered by host.
A finished template is rejected if its labelled bad rate, smoothed towards the rate of all
labelled pages, reaches :data:`REJECT`.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is
judged as the template of the empty path; equal urls are judged alike; a page may be unlabelled;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: (host, path, verdict): fits the host and its subdomains and paths that start with the path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
#: Pages of a literal segment, however many its node has.
MIN_PAGES = 20
#: A sibling differs if its deviate is at least this.
DEVIATE = 2.58
#: Weight of the overall rate, and the smoothed bad rate that rejects a template.
PRIOR, REJECT = 10.0, 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, bad: boolean or null, other columns) with a column ``template``.

    Level by level, until no node is left that could have a literal branch: a node with fewer pages than
    a branch needs and a sibling takes wildcards to the end of its pages' paths."""
    segs, seg, size = fresh(pages, "segments", "segment", "node_size")
    rows = staged(pages.withColumn(segs, F.array_remove(F.split("path", "/", -1), "")).withColumn("template", F.lit("")),
                  "url-pages")
    done, level = [], 0
    while True:
        # rows whose path goes on, in nodes that can still branch
        nodes = rows.where(F.size(segs) > level).groupBy("host", "template").agg(F.count(F.lit(1)).alias(size))
        grows = staged(nodes.where(F.col(size) > MIN_PAGES).select("host", "template", F.lit(True).alias(size)), "url-nodes")
        marked = rows.join(grows, ["host", "template"], "left")
        goes_on = F.coalesce(F.col(size), F.lit(False)) & (F.size(segs) > level)
        rest = F.repeat(F.lit("/*"), F.greatest(F.size(segs) - level, F.lit(0)))
        done.append(marked.where(~goes_on).withColumn("template", F.concat("template", rest)).drop(size))
        if grows.limit(1).count() == 0:
            break
        rows = marked.where(goes_on).drop(size).withColumn(seg, F.get(segs, F.lit(level)))
        child = staged(rows.groupBy("host", "template", seg).agg(
            F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"),
            F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("hit")), "url-children")
        node = child.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("lab").alias("all_lab"),
                                                     F.sum("hit").alias("all_hit"))
        rate = F.col("all_hit") / F.greatest(F.col("all_lab"), F.lit(1))
        rest = F.col("all_lab") - F.col("lab")
        rest_rate = (F.col("all_hit") - F.col("hit")) / F.greatest(rest, F.lit(1))
        spread = F.sqrt(rate * (1 - rate) * (1 / F.greatest(F.col("lab"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        differs = ((F.col("lab") > 0) & (rest > 0) & (spread > 0)
                   & (F.abs(F.col("hit") / F.greatest(F.col("lab"), F.lit(1)) - rest_rate) >= DEVIATE * spread))
        literal = child.join(node, ["host", "template"]).where(
            (F.col("n") >= MIN_PAGES) & differs).select(
            "host", "template", seg, F.lit(True).alias("literal"))
        rows = rows.join(literal, ["host", "template", seg], "left")
        step = F.concat(F.lit("/"), F.when(F.col("literal"), F.col(seg)).otherwise("*"))
        rows = staged(rows.withColumn("template", F.concat("template", step)).drop("literal", seg), "url-templates")
        level += 1
    return reduce(lambda x, y: x.unionByName(y), done).drop(segs)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url, bad) -> page_id, host, path, rule, verdict, template."""
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                        F.col("bad").cast("boolean").alias("bad"))
    rows = templates(rows)
    counted = rows.groupBy("host", "template").agg(F.count("bad").alias("lab"),
                                                   F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("hit"))
    every = counted.agg(F.sum("hit"), F.sum("lab")).first()
    overall = (every[0] or 0) / (every[1] or 1)
    bad_rate = (F.col("hit") + PRIOR * overall) / (F.col("lab") + PRIOR)
    rejected = counted.where(bad_rate >= REJECT).select("host", "template", F.lit("block").alias("learned"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.join(rejected, ["host", "template"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.col("learned"), F.lit("allow")).alias("verdict"), "template")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, bad): a page's label is that of the document whose id its path carries;
    bad if a label of that document has quality 0."""
    number = F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    # pages without a number get keys of their own, so that they do not meet in one task
    key = F.when(number == "", -1 - F.abs(F.xxhash64("page_id", "url") % (1 << 62))).otherwise(
        F.expr("0")).cast("long")
    key = F.when(number == "", key).otherwise(number.try_cast("long"))
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("key")).agg((F.min("quality") == 0).alias("bad")))
    return pages.select("page_id", "url", key.alias("key")).join(lab, "key", "left").select("page_id", "url", "bad")
