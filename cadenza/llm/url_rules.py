"""URL filters: fixed rules for hosts and paths, and rules mined from labels by FP-growth.

A fixed rule decides wherever one fits. For all other urls, combinations of url tokens that point to
bad pages are mined from labelled pages with Spark's FP-growth, pruned by support and by confidence
(the lower end of its 95 % interval must also pass, so a few rows never make a rule), and reduced to
those that no shorter rule implies. A url is looked up by its tokens in an inverted index that holds
every mined rule once, under its rarest token, and blocked if it has all tokens of a rule.

Defined results:
- A missing url, or one without "://", has an empty host and path; no fixed rule fits it.
- Rows that share a page_id are judged one by one, by their url. A missing page_id is kept.
- Without labelled pages, or with no rule left, all urls without a fixed rule are allowed.
- Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.line_dedup import LOWER, UPPER
from cadenza.session import cut

BAD = "label=bad"
Z = 1.96


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The name and verdict of the longest of the rules (verdict, host, path) that fits, else missing."""
    name = verdict = F.lit(None).cast("string")
    # Written from the shortest to the longest, so that the longest is asked first.
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _named(kind: str, values: Column) -> Column:
    found = F.filter(values, lambda v: v != "")
    return F.transform(found, lambda v: F.concat(F.lit(kind), F.regexp_replace(v, "[0-9]+", "0")))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments, query keys. Digits count as one sign."""
    known = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(known, r"\?([^#]*)", 1)
    parts = {
        "scheme=": F.array(F.regexp_extract(known, "^([^:/?#]*)://", 1)),
        "host=": F.split(host_of(url), r"\."),
        "path=": F.split(F.translate(path_of(url), UPPER, LOWER), r"[/.]"),
        "query=": F.transform(F.split(query, "[&;]"), lambda pair: F.regexp_extract(pair, "^[^=]*", 0)),
    }
    named = [_named(kind, values) for kind, values in parts.items()]
    return F.array_distinct(F.concat(*named))


def lower_bound(hits: Column, n: Column) -> Column:
    """The lower end of the 95 % interval of a share, after Wilson."""
    share = hits / n
    centre = share + Z * Z / (2 * n)
    return (centre - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def mine_rules(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lower: float = 0.5
) -> DataFrame:
    """tokens, anchor, confidence, n of rules "these tokens: bad", from rows (tokens, bad).

    min_support is the share of labelled rows that have the tokens and are bad.
    """
    baskets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    baskets = cut(baskets.filter(F.size("items") > 0))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = cut(model.freqItemsets)
    with_bad = found.filter(F.array_contains("items", BAD) & (F.size("items") > 1))
    hits = with_bad.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("hits"))
    all_ = found.filter(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    rules = hits.join(all_, "tokens").filter(F.col("hits") / F.col("n") >= min_confidence)
    rules = cut(rules.filter(lower_bound(F.col("hits"), F.col("n")) >= min_lower))
    single = found.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_n"))
    each = rules.select("tokens", "hits", "n", F.explode("tokens").alias("token")).join(single, "token")
    anchored = each.groupBy("tokens", "hits", "n").agg(F.min(F.struct("token_n", "token")).getField("token").alias("anchor"))
    return _shortest(cut(anchored)).select("tokens", "anchor", (F.col("hits") / F.col("n")).alias("confidence"), "n")


def _shortest(rules: DataFrame) -> DataFrame:
    """Rules without those of which another rule needs only some of the tokens."""
    within = rules.select("tokens", F.explode("tokens").alias("token")).join(
        rules.select(F.col("tokens").alias("fewer"), F.col("anchor").alias("token")), "token"
    )
    implied = within.filter(
        (F.size("fewer") < F.size("tokens")) & (F.size(F.array_intersect("tokens", "fewer")) == F.size("fewer"))
    )
    return rules.join(implied.select("tokens").distinct(), "tokens", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls, once each, that have all tokens of a rule."""
    known = urls.select("url", tokens_of(F.col("url")).alias("own")).select("url", "own", F.explode("own").alias("anchor"))
    met = known.join(rules.select("anchor", "tokens"), "anchor")
    return met.filter(F.size(F.array_intersect("own", "tokens")) == F.size("tokens")).select("url").distinct()


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    **mining: float,
) -> DataFrame:
    """page_id, host, path, rule, verdict. labels: (page_id, bad) of some pages, one row for each."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    marked = labels.select(F.col("page_id").alias("__id"), "bad").filter("bad IS NOT NULL")
    labelled = own.join(marked, F.col("page_id") == F.col("__id")).select(tokens_of(F.col("url")).alias("tokens"), "bad")
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    read = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = read.withColumn("rule", name).withColumn("ruled", verdict)
    open_urls = ruled.filter(F.col("rule").isNull()).select("url").distinct()
    # Written, so that the join can split a url that very many pages share.
    blocked = cut(matched(open_urls, mine_rules(labelled, **mining)))
    blocked = blocked.select(F.col("url").alias("__url"), F.lit(True).alias("hit"))
    joined = ruled.join(blocked, F.col("url") == F.col("__url"), "left")
    mined = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", mined).alias("verdict"))
