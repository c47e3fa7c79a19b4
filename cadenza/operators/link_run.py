"""A whole run of link matching: matched and written once, its figures counted by that one pass.

The figures are observed while the rows are written, and what failed is read from the rows written, so
no report runs the matching again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cadenza.operators import matching as mt
from cadenza.operators.skew import HOT_ROWS
from cadenza.session import cut, new_path

FIGURES = "service string, total long, saved long, failed_saves long, failed_fetches long, links_found long"


@dataclass(frozen=True)
class Widths:
    """How many characters the link table holds of each; a longer value is no row of it."""

    song_id: int = 22
    url: int = 500


@dataclass(frozen=True)
class LinkRun:
    """cleaned: the input. links: what was matched, with `fits` where the whole save is possible.
    figures: one row per service."""

    cleaned: DataFrame
    links: DataFrame
    figures: DataFrame

    def failures(self, run_at: datetime | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
        return mt.link_failures(self.cleaned, self.links, run_at, hot_rows)

    def updates(self) -> DataFrame:
        """What can be saved, as changes of the link table."""
        return mt.link_updates(self.links.filter("fits"))


def _total(service: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when((F.col("service") == service) & condition, F.col("n"))), F.lit(0))


def run_links(
    cleaned: DataFrame, candidates: DataFrame, rules, widths: Widths = Widths(), hot_rows: int = HOT_ROWS
) -> LinkRun:
    """Match, write, and count in rows of the input.

    A song (or song and album) is saved with the links of all services at once, so a link that the
    table cannot hold, or such an id, fails the save for all of them. Rows without a usable name count
    as read but are neither saved nor failed.
    """
    spark = cleaned.sparkSession
    rules = rules if isinstance(rules, tuple) else (rules,)
    name = uuid.uuid4().hex
    read, wrote = Observation(f"read-{name}"), Observation(f"wrote-{name}")
    counted = cleaned.observe(read, F.count(F.lit(1)).alias("total"), F.count_if(~F.col("skipped")).alias("usable"))
    rows = cut(counted)
    links = mt.match_links(rows, candidates, rules)
    named, keys = mt.keyed(rows.filter(~F.col("skipped")), links)
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fits = (F.char_length("song_id") <= widths.song_id) & (F.coalesce(F.char_length("url"), F.lit(0)) <= widths.url)
    # A key has a row per service, and the join has brought them together.
    whole = Window.partitionBy(*keys)
    met = links.join(counts, keys).withColumn("fits", F.min(F.coalesce(fits, F.lit(False))).over(whole))
    services = [r.service for r in rules]
    found, saved = F.col("url").isNotNull(), F.col("fits")
    metrics = [
        _total(s, condition).alias(f"{what}_{s}")
        for s in services
        for what, condition in (("failed_saves", ~saved), ("failed_fetches", ~found), ("links_found", found & saved))
    ]
    path = new_path(spark, "links")
    met.observe(wrote, *metrics).write.parquet(path)
    first, last = read.get, wrote.get
    figures = [
        (s, first["total"], first["usable"] - last[f"failed_saves_{s}"], *(last[f"{w}_{s}"] for w in ("failed_saves", "failed_fetches", "links_found")))
        for s in services
    ]
    return LinkRun(rows, spark.read.parquet(path), spark.createDataFrame(figures, FIGURES))
