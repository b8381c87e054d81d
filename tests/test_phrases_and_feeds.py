"""Stems against published examples, key phrases against a plain count, and nested feeds as tables and streams."""

import datetime
import json
from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions import stem
from tidemark.operators import phrases
from tidemark.sources import readers

#: Words and stems from the description of the algorithm.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formality formal sensitivity sensit triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controlling control rolling roll generalizations gener oscillators oscil is is a a""".split()


def test_stems_are_the_published_ones(spark):
    words, expect = PUBLISHED[::2], PUBLISHED[1::2]
    assert [stem.porter(w) for w in words] == expect
    df = spark.createDataFrame([(words,), (None,), ([],), (["naïve", None, "x1s"],)], "w array<string>")
    assert [r["s"] for r in df.select(stem.stems(F.col("w")).alias("s")).collect()] == [expect, None, [], ["naïve", None, "x1s"]]


def test_key_phrases(spark):
    texts = [("a", "red fox red fox blue fox hens hen hen's running runs run"), ("b", "one"), ("c", ""), ("d", None), (None, "lost"), ("e", " ".join(f"w{k}" for k in range(100)))]
    df = spark.createDataFrame(texts, "id string, text string")
    split = F.filter(F.split("text", " "), lambda w: w != "")
    for stemmed in (False, True):
        got = {}
        for r in phrases.key_phrases(df, "id", split, 5, stemmed).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["phrase"], r["weight"]))
        for k, t in texts:
            ws = (t or "").split()
            if stemmed:
                by, count = {}, Counter(ws)
                for w in ws:
                    by.setdefault(stem.porter(w), []).append(w)
                ws = [min(by[stem.porter(w)], key=lambda x: (-count[x], x)) for w in ws]
            words, pairs = Counter(ws), Counter(map(" ".join, zip(ws, ws[1:], strict=False)))
            top = lambda c, n: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n])
            score = {**{w: float(c) for w, c in top(words, 30).items()}, **{p: 1.5 * c for p, c in top(pairs, 20).items()}}
            expect = [(i + 1, p, s) for i, (p, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])]
            assert sorted(got.get(k, [])) == (expect if k else [])


SHOW = """<rss xmlns:itunes="urn:x"><channel><title>{show}</title><image><url>http://i/show</url></image>
<item><title>One</title><description>First &lt;b&gt;talk&lt;/b&gt;</description><link>http://l/{show}/1</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate><itunes:duration>60</itunes:duration><itunes:image href="http://i/1"/><enclosure url="http://a/1.mp3" type="audio/mpeg"/></item>
<item><title>Two</title></item></channel></rss>"""
VIDEO = {"items": [{"id": {"videoId": "v1"}, "snippet": {"title": "T", "description": "D", "channelTitle": "C", "publishedAt": "2024-02-05T10:00:00Z", "thumbnails": {"medium": {"url": "m"}, "high": {"url": "h"}}}}, {"id": {}, "snippet": {"title": "none"}}, {"id": {"videoId": "v2"}}]}


def test_nested_feeds(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "v").mkdir()
    for show in ("S", "Empty"):
        (tmp_path / "p" / f"{show}.xml").write_text(SHOW.format(show=show) if show == "S" else "<rss><channel><title>E</title></channel></rss>")
    (tmp_path / "v" / "1.json").write_text(json.dumps(VIDEO))
    rows = {r["title"]: r for r in readers.podcasts(spark, f"{tmp_path}/p", "pod").collect()}
    assert rows.keys() == {"[S] One", "[S] Two"}
    one, two = rows["[S] One"], rows["[S] Two"]
    assert one["content"] == "Duration: 60s Podcast: S First talk" and one["audio_url"] == "http://a/1.mp3" and one["audio_type"] == "audio/mpeg" and one["image_urls"] == ["http://i/1"] and one["duration"] == "60"
    assert one["published_at"] == datetime.datetime(2024, 2, 5, 10) and one["source_type"] == "podcast" and two["image_urls"] == ["http://i/show"] and two["audio_url"] is None and two["published_at"] is None
    found = {r["url"]: r for r in readers.videos(spark, f"{tmp_path}/v", "vid", "http://w?v=").collect()}
    assert found.keys() == {"http://w?v=v1", "http://w?v=v2"} and found["http://w?v=v1"]["image_urls"] == ["h"] and found["http://w?v=v1"]["published_at"] == datetime.datetime(2024, 2, 5, 10)


def test_nested_feeds_as_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for k, show in enumerate(("A", "B")):
        (tmp_path / "in" / f"{show}.xml").write_text(SHOW.format(show=show))
        readers.podcasts(spark, f"{tmp_path}/in", "pod", stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == 2 * (k + 1)
    batch = {r["id"] for r in readers.podcasts(spark, f"{tmp_path}/in", "pod").collect()}
    assert {r["id"] for r in spark.read.parquet(out).collect()} == batch
