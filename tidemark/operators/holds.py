"""Legal holds as a table of criteria: which items they hold, what is preserved of them, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of so many holds or fewer is sent to the tasks; of more, Spark chooses how they meet the items.
KNOWN = 10_000
HOLDS = "hold string, status string, keywords array<string>, sources array<string>, topics array<string>, authors array<string>, domains array<string>, date_from timestamp, date_to timestamp"
ITEM = ("id", "title", "content", "source", "topics", "author_name", "url", "published_at")


def _any(wanted: str, test) -> Column:
    """Whether a criterion is met: it names nothing, or ``test`` holds for something that it names."""
    return F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.coalesce(F.exists(wanted, test), F.lit(False))


def held(items: DataFrame, holds: DataFrame) -> DataFrame:
    """``hold, id`` of every item that meets all criteria of an active hold.

    items: the items schema; holds: HOLDS. Keywords stand anywhere in title, content and source whatever their case, topics match whatever their case, sources and authors exactly, domains anywhere in the
    url; dates bound the publication, both inclusive, and an item without one meets them. A criterion that is null or names nothing holds for all items, so a hold of none holds everything. The
    items are a stated set of holds' candidates: each is read once and meets the holds' table, of which only matches are kept. Repeated rows are one.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    i = items.select(F.col("id"), F.concat_ws(" ", text("title"), text("content"), text("source")).alias("_text"), F.col("source").alias("_source"), F.transform("topics", F.lower).alias("_topics"),
                     F.col("author_name").alias("_author"), F.coalesce("url", F.lit("")).alias("_url"), F.col("published_at").alias("_at"))
    active = holds.where("status = 'active'").select("hold", F.transform("keywords", F.lower).alias("keywords"), "sources", F.transform("topics", F.lower).alias("topics"), "authors", "domains", "date_from", "date_to")
    met = (
        _any("sources", lambda x: x == F.col("_source")) & _any("authors", lambda x: x == F.col("_author")) & _any("topics", lambda x: F.array_contains("_topics", x)) & _any("domains", lambda x: F.col("_url").contains(x))
        & (F.col("_at").isNull() | ((F.col("date_from").isNull() | (F.col("_at") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("_at") <= F.col("date_to"))))) & _any("keywords", lambda x: F.col("_text").contains(x))
    )
    return i.join(F.broadcast(active) if active.count() <= KNOWN else active, met).select("hold", "id").distinct()


def preserved(items: DataFrame, matches: DataFrame, at: Column, before: DataFrame | None = None) -> DataFrame:
    """``hold, id, snapshot, preserved_at``: what ``before`` has, and the item as JSON for each match that it lacks. What is preserved never changes; of rows that share an id the least snapshot is taken."""
    snapshot = items.groupBy("id").agg(F.min(F.to_json(F.struct(*ITEM))).alias("snapshot"))
    fresh = matches if before is None else matches.join(before.select("hold", "id"), ["hold", "id"], "left_anti")
    new = fresh.join(snapshot, "id").select("hold", "id", "snapshot", at.cast("timestamp").alias("preserved_at"))
    return new if before is None else before.select("hold", "id", "snapshot", "preserved_at").unionByName(new)


def export(kept: DataFrame, path: str) -> None:
    """The preserved items as JSON lines, a folder for each hold."""
    kept.write.partitionBy("hold").json(path)
