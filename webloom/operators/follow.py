"""W10 multi-page follow: from each start page follow its next-page link up
to ``max_pages`` pages; a URL already visited from the same start (a cycle)
or a URL missing from the snapshot ends the walk.

Each page has one next URL, so walks are pointers and are doubled: a round
joins the jumps of 2^k hops with themselves, and the walks so far with those
jumps.  ``log2(max_pages)`` rounds make all hops.  A walk that meets a URL
again only repeats itself from there on; the first visit of each URL is
kept, found by one minimum for each (start, URL).  The rounds' tables are
stored in the shared folder, so lineage stays short and a lost executor
recomputes one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.batch import page_key
from webloom.sources.tables import stored


def next_links(links: DataFrame, pick: Column | None = None) -> DataFrame:
    """``(page_id, next_url)``: the first link (document order) satisfying
    ``pick`` on each page; partial aggregation (min by pos) per page."""
    cand = links if pick is None else links.where(pick)
    return cand.groupBy("page_id").agg(F.min_by("href", "pos").alias("next_url"))


def follow_links(pages: DataFrame, nexts: DataFrame, max_pages: int) -> DataFrame:
    """``(start, hop, url)``: hop 0 is the start page; hop k the k-th followed link."""
    # Of pages with one normalised URL the least id counts; the two-column table is made once.
    snap = pages.groupBy(page_key("url").alias("_u")).agg(F.min("page_id").alias("_pid"))
    jump = stored(snap.join(nexts, snap["_pid"] == nexts["page_id"])
                  .where(F.col("next_url").isNotNull())
                  .select(F.col("_u").alias("_from"), page_key("next_url").alias("_to"), F.col("next_url").alias("_url")))
    walks = pages.select(F.col("page_id").alias("start"), F.lit(0).cast("int").alias("hop"), "url", page_key("url").alias("_key"))
    hops = 1                    # how many hops a walk has so far, and how far a jump goes
    while hops < max_pages:
        ahead = (walks.join(jump, walks["_key"] == jump["_from"])
                 .select("start", (F.col("hop") + hops).cast("int").alias("hop"), F.col("_url").alias("url"), F.col("_to").alias("_key"))
                 .where(F.col("hop") < max_pages))
        walks = stored(walks.unionByName(ahead))
        hops *= 2
        if hops < max_pages:
            far = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_to2"), F.col("_url").alias("_url2"))
            jump = stored(jump.drop("_url").join(far, "_to").select("_from", F.col("_to2").alias("_to"), F.col("_url2").alias("_url")))
    # The first visit of each URL; the rows after a repeat are repeats themselves.
    first = walks.groupBy("start", "_key").agg(F.min(F.struct("hop", "url")).alias("v"))
    return first.select("start", "v.hop", "v.url")
