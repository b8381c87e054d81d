"""Readers on files that Spark writes from the conversations: posts as JSON, a feed as XML, and shows of nested episodes."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators.graph import checkpoints
from tidemark.plans.registry import query, read
from tidemark.sources import readers

CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace({text}, '<[^>]*>', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s.,!?:;()#@/-]', '', 'g'), '\\s+', ' ', 'g'))"
URL = "'http://talk.example/' || conv_id || '/' || turn"
#: Turns of one channel: a conversation of more is several, so no row grows with a conversation.
TURNS = 50


def _turns(spark, sf):
    url = F.concat(F.lit("http://talk.example/"), F.col("conv_id"), F.lit("/"), F.col("turn"))
    return read(spark, sf, "conversations").withColumns({"url": url, "seconds": F.col("conv_id") * 3600 + F.col("turn") * 60})


def _folder(spark):
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _shown(items, *more):
    return items.select("id", "title", "content", "url", "author_name", F.unix_timestamp("published_at").alias("published"), "engagement", *more)


@query(f"""SELECT md5('posts:' || {URL}) AS id, 'talk ' || conv_id AS title, {CLEAN.format(text="text")} AS content, {URL} AS url, role AS author_name, conv_id * 3600 + turn * 60 AS published, CAST(length(text) AS BIGINT) AS engagement FROM conversations""")
def posts_from_files(spark, sf):
    """Nested posts written as JSON and read again into items."""
    at, t = _folder(spark), _turns(spark, sf)
    t.select(F.concat(F.lit("talk "), "conv_id").alias("title"), F.col("text").alias("body"), "url", F.struct(F.col("role").alias("name")).alias("author"), F.col("seconds").alias("time"), F.length("text").alias("likes")).write.json(at)
    return _shown(readers.json_posts(spark, at, "posts"))


@query(f"""SELECT md5('feed:' || {URL}) AS id, 'talk ' || conv_id AS title, {CLEAN.format(text="text")} AS content, {URL} AS url, role AS author_name, conv_id * 3600 + turn * 60 AS published, CAST(NULL AS BIGINT) AS engagement FROM conversations""")
def feed_from_files(spark, sf):
    """An RSS feed written as XML and read again into items."""
    at, t = _folder(spark), _turns(spark, sf)
    date = F.date_format(F.timestamp_seconds("seconds"), "EEE, d MMM yyyy HH:mm:ss xx")
    t.select(F.concat(F.lit("talk "), "conv_id").alias("title"), F.col("text").alias("description"), F.col("url").alias("link"), date.alias("pubDate"), F.col("role").alias("dc:creator")).write.format("xml").option("rootTag", "rss").option("validateName", "false").option("rowTag", "item").save(at)
    return _shown(readers.feed(spark, at, "feed"))


@query(f"""SELECT md5('pod:' || {URL}) AS id, '[talk ' || conv_id || '] part ' || turn AS title, {CLEAN.format(text="'Podcast: talk ' || conv_id || chr(10) || text")} AS content, {URL} AS url, 'talk ' || conv_id AS author_name, conv_id * 3600 + turn * 60 AS published, CAST(NULL AS BIGINT) AS engagement, {URL} || '.mp3' AS audio_url, 'audio/' || role AS audio_type FROM conversations""")
def podcasts_from_files(spark, sf):
    """Shows of nested episodes with enclosures, written as XML and read again."""
    at, t = _folder(spark), _turns(spark, sf)
    date = F.date_format(F.timestamp_seconds("seconds"), "EEE, d MMM yyyy HH:mm:ss xx")
    enclosure = F.struct(F.concat("url", F.lit(".mp3")).alias("_url"), F.concat(F.lit("audio/"), "role").alias("_type"))
    item = F.struct(F.concat(F.lit("part "), "turn").alias("title"), F.col("text").alias("description"), F.col("url").alias("link"), date.alias("pubDate"), enclosure.alias("enclosure"))
    shows = t.groupBy("conv_id", F.floor(F.col("turn") / TURNS)).agg(F.collect_list(item).alias("item"))
    shows.select(F.concat(F.lit("talk "), "conv_id").alias("title"), "item").write.format("xml").option("rootTag", "rss").option("validateName", "false").option("rowTag", "channel").save(at)
    return _shown(readers.podcasts(spark, at, "pod"), "audio_url", "audio_type")
