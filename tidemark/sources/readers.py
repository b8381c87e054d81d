"""Items from files. Schemas are explicit, so nothing is inferred and only named columns are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X

ITEMS = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("id", "title", "content", "url", "source", "source_type", "author_name")),
    T.StructField("published_at", T.TimestampType()),
    *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("hashtags", "topics")),
    T.StructField("engagement", T.LongType()),
])


def as_items(df: DataFrame, source: str, source_type: str, extra: dict[str, Column] | None = None, **columns) -> DataFrame:
    """``df`` in the items schema, and ``extra`` columns behind it: ``columns`` gives the expressions that it has; the key is the url, or else the text's start."""
    col = {k: (F.expr(v) if isinstance(v, str) else v) for k, v in columns.items()}
    content = X.clean_markup(F.coalesce(col.get("content", F.lit("")), F.lit("")))
    url = col.get("url", F.lit(None).cast("string"))
    key = F.coalesce(F.nullif(url, F.lit("")), F.substring(content, 1, 100))
    given = {"id": X.surrogate_key(F.lit(source), key), "content": content, "url": url, "source": F.lit(source), "source_type": F.lit(source_type), "hashtags": X.hashtags(content)}
    return df.select(*(given.get(f.name, col.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in ITEMS), *(c.alias(k) for k, c in (extra or {}).items()))


def json_posts(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Nested posts: author and user structs, likes or engagement, epoch or text times."""
    schema = "title string, body string, text string, url string, author struct<name:string>, user struct<name:string>, created_at string, time long, likes long, engagement long"
    raw = spark.read.schema(schema).json(path)
    at = F.coalesce(F.timestamp_seconds("time"), F.col("created_at").try_cast("timestamp"))
    return as_items(raw, source, "post", title="title", content=F.coalesce("body", "text", F.lit("")), url="url", author_name=F.coalesce("author.name", "user.name"), published_at=at, engagement=F.coalesce("likes", "engagement", F.lit(0)))


def feed(spark: SparkSession, path: str, source: str, row_tag: str = "item") -> DataFrame:
    """RSS (``item``) or Atom (``entry``) through Spark's XML reader; content:encoded before description, dc:creator before author."""
    schema = "title string, description string, summary string, content string, `content:encoded` string, link string, pubDate string, published string, updated string, `dc:creator` string"
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "false").schema(schema).load(path)
    rfc = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss xx"))
    at = F.coalesce(rfc, F.col("published").try_cast("timestamp"), F.col("updated").try_cast("timestamp"))
    return as_items(raw, source, "feed", title="title", content=F.coalesce("`content:encoded`", "content", "description", "summary"), url="link", author_name="`dc:creator`", published_at=at)


def _load(spark: SparkSession, kind: str, schema: str, path: str, stream: bool, **options: str) -> DataFrame:
    """Files of a folder at once, or as a stream that takes each new file once."""
    reader = (spark.readStream if stream else spark.read).format(kind).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def podcasts(spark: SparkSession, path: str, source: str, stream: bool = False) -> DataFrame:
    """Episodes of podcast feeds: the items schema with ``image_urls, show, duration, audio_url, audio_type``.

    A channel is one record with its items inside, so show, episode and enclosure come from one pass over the file. The episode's image stands before the show's; titles
    and contents name the show. A channel without items gives nothing; a broken file is skipped like any malformed record.
    """
    item = "struct<title:string, description:string, link:string, pubDate:string, `itunes:duration`:string, `itunes:image`:struct<_href:string>, enclosure:struct<_url:string, _type:string, _VALUE:string>>"
    schema = f"title string, description string, image struct<url:string>, `itunes:image` struct<_href:string>, item array<{item}>"
    raw = _load(spark, "xml", schema, path, stream, rowTag="channel", ignoreNamespace="false", mode="DROPMALFORMED")
    e = raw.select(F.col("title").alias("show"), F.coalesce("image.url", F.col("itunes:image")["_href"]).alias("show_image"), F.explode("item").alias("e"))
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace("e.pubDate", "^[A-Za-z]+, ", ""), "(GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss xx"))
    duration, image = F.col("e")["itunes:duration"], F.coalesce(F.col("e")["itunes:image"]["_href"], F.col("show_image"))
    content = F.concat(F.when(duration != "", F.concat(F.lit("Duration: "), duration, F.lit("s\n"))).otherwise(""), F.concat(F.lit("Podcast: "), F.coalesce("show", F.lit("")), F.lit("\n"), F.coalesce("e.description", F.lit(""))))
    extra = {"image_urls": F.when(image.isNotNull(), F.array(image)).otherwise(F.array().cast("array<string>")), "show": F.col("show"), "duration": duration, "audio_url": F.col("e.enclosure._url"), "audio_type": F.col("e.enclosure._type")}
    return as_items(e, source, "podcast", extra, title=F.concat(F.lit("["), F.coalesce("show", F.lit("")), F.lit("] "), F.coalesce("e.title", F.lit(""))), content=content, url=F.col("e.link"), author_name=F.col("show"), published_at=at)


def videos(spark: SparkSession, path: str, source: str, watch: str, stream: bool = False) -> DataFrame:
    """Videos of saved search answers (nested JSON, one answer a file): the items schema with ``image_urls, video_url``; links are ``watch`` and the id. The large picture stands before the medium one."""
    picture = "struct<url:string>"
    snippet = f"struct<title:string, description:string, channelTitle:string, channelId:string, publishedAt:string, thumbnails:struct<high:{picture}, medium:{picture}>>"
    raw = _load(spark, "json", f"items array<struct<id:struct<videoId:string>, snippet:{snippet}>>", path, stream, multiLine="true")
    e = raw.select(F.explode("items").alias("e")).where("e.id.videoId is not null")
    link, image = F.concat(F.lit(watch), F.col("e.id.videoId")), F.coalesce("e.snippet.thumbnails.high.url", "e.snippet.thumbnails.medium.url")
    extra = {"image_urls": F.when(image.isNotNull(), F.array(image)).otherwise(F.array().cast("array<string>")), "video_url": link}
    return as_items(e, source, "video", extra, title=F.col("e.snippet.title"), content=F.col("e.snippet.description"), url=link, author_name=F.col("e.snippet.channelTitle"), published_at=F.col("e.snippet.publishedAt").try_cast("timestamp"))


def csv_items(spark: SparkSession, path: str, source: str) -> DataFrame:
    raw = spark.read.schema("title string, content string, url string, author string, published_at timestamp, engagement long").option("header", True).csv(path)
    return as_items(raw, source, "csv", title="title", content="content", url="url", author_name="author", published_at="published_at", engagement="engagement")


def text_files(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One item for each file."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    return as_items(raw, source, "file", title=F.element_at(F.split("path", "/"), -1), content="value", url="path")


def documents(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    return as_items(raw, "corpus", "document", title="substring(text, 1, 60)", content="text", url="concat('doc:', doc_id)", topics="array(lang)", engagement="n_chars")


READERS: dict[str, Callable[..., DataFrame]] = {"posts": json_posts, "feed": feed, "csv": csv_items, "text": text_files}


def collect(spark: SparkSession, sources: list[tuple[str, str, str]], enabled: list[str] | None = None) -> DataFrame:
    """All of ``(reader, path, source)`` in one frame; sources that aren't enabled are left out and an unknown reader is an error."""
    frames = [READERS[kind](spark, path, source) for kind, path, source in sources if enabled is None or source in enabled]
    out = spark.createDataFrame([], ITEMS)
    for f in frames:
        out = out.unionByName(f)
    return out
