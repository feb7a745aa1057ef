"""URL verdicts by rules, and for the rest by a tree of path templates per host.

URLs that a rule decides are the labels. Each host's paths form a tree of segments; runs of digits, and segments that are
rare among their siblings, become wildcards. A branch whose share of blocked labels does not differ significantly from that
of its siblings together is merged with them. A template is rejected if its smoothed share of blocked labels reaches
``REJECT``; one without labels keeps the prior and is allowed.

Null URLs and those without ``://`` have an empty host and path; no rule fits them and they are allowed. Rows that repeat
are judged alike, a null id stays null. Paths deeper than ``DEPTH`` share the template of their first segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.common import stored

# fixed values: verdict, host and path prefix of the rules
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEPTH = 6
MIN_SHARE = 0.02   # of its parent's URLs that a segment needs to stay literal
PRIOR, STRENGTH = 0.1, 2.0
REJECT = 0.8
Z = 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values)])
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def _segments(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/")
    return F.when(F.size(parts) > DEPTH + 1, F.concat(F.slice(parts, 1, DEPTH + 1), F.array(F.lit("**")))).otherwise(parts)


def templates(shapes: DataFrame) -> DataFrame:
    """``host, shape, template`` from ``host, shape, n``: rare segments become wildcards, level by level.

    Sums per node are grouped sums; a host with very many URLs sends few rows, as equal shapes are one row already.
    """
    tree = shapes.select("host", "shape", "n", F.split("shape", "/").alias("_s"), F.lit("").alias("_t"))
    deepest = shapes.agg(F.max(F.size(F.split("shape", "/")))).first()[0] or 0  # DEPTH + 2 at most
    for level in range(deepest):
        here = F.get("_s", F.lit(level))
        children = tree.filter(F.size("_s") > level).groupBy("host", "_t", here.alias("_c")).agg(F.sum("n").alias("_n"))
        totals = children.groupBy("host", "_t").agg(F.sum("_n").alias("_all"))
        literal = children.join(totals, ["host", "_t"]).filter(F.col("_n") >= MIN_SHARE * F.col("_all")).select("host", "_t", "_c", F.lit(True).alias("_keep"))
        tree = tree.withColumn("_c", here).join(literal, ["host", "_t", "_c"], "left").select(
            "host", "shape", "n", "_s", F.when(F.col("_c").isNull(), F.col("_t")).otherwise(
                F.concat("_t", F.lit("/" if level else ""), F.when(F.col("_keep"), F.col("_c")).otherwise("*"))).alias("_t"))
        if level % 3 == 2:
            tree = stored(tree, "tree")
    return tree.select("host", "shape", F.col("_t").alias("template"))


def merged(stats: DataFrame) -> DataFrame:
    """``host, template, merged, purity`` from ``host, template, blocked, labelled``."""
    parent = F.regexp_replace("template", r"[^/*]+(?=(/[*#.\w]*)?$)", "*")
    own = stats.withColumn("_parent", parent)
    pooled = own.groupBy("host", "_parent").agg(F.sum("blocked").alias("_b"), F.sum("labelled").alias("_l"))
    both = own.join(pooled, ["host", "_parent"])
    share, together = F.col("blocked") / F.col("labelled"), F.col("_b") / F.col("_l")
    spread = F.sqrt(together * (1 - together) * (1 / F.col("labelled") + 1 / F.col("_l")))
    alike = F.when((F.col("labelled") > 0) & (F.col("_l") > F.col("labelled")), F.abs(share - together) <= Z * spread).otherwise(False)
    smooth = lambda b, n: (F.col(b) + F.lit(PRIOR * STRENGTH)) / (F.col(n) + F.lit(STRENGTH))
    return both.select("host", "template", F.when(alike, F.col("_parent")).otherwise(F.col("template")).alias("merged"),
                       F.when(alike, smooth("_b", "_l")).otherwise(smooth("blocked", "labelled")).alias("purity"))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``<id>, host, path, rule, verdict, template, purity`` for each row; template and purity where no rule decides."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_by_rule", verdict).withColumn("shape", F.array_join(_segments(F.col("path")), "/"))
    shapes = stored(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("_by_rule") == "block").alias("blocked"),
                                                      F.count("_by_rule").alias("labelled")), "shapes")
    named = stored(shapes.join(templates(shapes), ["host", "shape"]), "templates")
    stats = named.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    judged = named.select("host", "shape", "template").join(merged(stats), ["host", "template"]).select("host", "shape", "merged", "purity")
    out = rows.join(judged, ["host", "shape"], "left")
    by_tree = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    undecided = F.col("_by_rule").isNull()
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_by_rule", by_tree).alias("verdict"),
                      F.when(undecided, F.col("merged")).alias("template"), F.when(undecided, F.col("purity")).alias("purity"))
