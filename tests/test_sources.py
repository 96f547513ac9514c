import json

import pytest
from pyspark.sql import functions as F

from attestor.sources import files, pages, sinks


def test_front_matter(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("---\ntitle: 'One: x'\ntopics:\n  - a\n  - b\nurls: [u, v]\nempty:\n---\nBody\nline\n")
    (tmp_path / "two.md").write_text("no front matter")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_front_matter(spark, str(tmp_path)).collect()}
    assert rows["one.md"].meta == {"title": ["One: x"], "topics": ["a", "b"], "urls": ["u", "v"], "empty": []}
    assert rows["one.md"].body == "Body\nline\n" and rows["one.md"].readable
    assert not rows["two.md"].readable and rows["two.md"].meta == {}
    with pytest.raises(Exception, match="no front matter"):
        files.read_front_matter(spark, str(tmp_path), strict=True).collect()


def test_registry_log_and_state(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"candidates": [{"id": "a", "name": "A"}, {"id": "b"}]}))
    assert [r.id for r in files.read_registry(spark, f"{tmp_path}/r.json", "candidates", "struct<id:string,name:string>").orderBy("id").collect()] == ["a", "b"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/2026-08-01.jsonl").write_text('{"k": 1}\nbroken\n')
    (tmp_path / "log/other.jsonl").write_text('{"k": 9}\n')
    assert [r.k for r in files.read_event_log(spark, f"{tmp_path}/log", "k int").collect()] == [1]
    (tmp_path / "s.json").write_text(json.dumps({"pages": {"u": {"sha": "x"}}}))
    assert [tuple(r) for r in files.read_keyed_state(spark, f"{tmp_path}/s.json", "pages", "sha:string").collect()] == [("u", "x")]
    assert files.read_keyed_state(spark, f"{tmp_path}/s.json", "absent", "sha:string").count() == 0


def test_pages(spark):
    df = spark.createDataFrame([("<style>..</style>Hello <b>world</b><script>bad()</script>",)], "html string")
    assert df.select(pages.page_text(F.col("html"))).first()[0] == "Hello world"
    maps = spark.createDataFrame([(1, '<urlset xmlns="n"><url><loc>u</loc><lastmod>d</lastmod></url></urlset>')], "id int, payload string")
    assert [tuple(r) for r in pages.shred_sitemap(maps, "payload").collect()] == [(1, "u", "d")]
    feeds = spark.createDataFrame([(1, '<feed xmlns="a"><entry><title>T</title><link href="l"/><updated>d</updated></entry></feed>'), (2, "<rss><channel><item><title>R</title><link>k</link><pubDate>p</pubDate></item></channel></rss>")], "id int, payload string")
    assert [tuple(r) for r in pages.shred_feed(feeds, "payload").orderBy("id").collect()] == [(1, "T", "l", "d"), (2, "R", "k", "p")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    for _ in range(2):
        sinks.append_if_absent(rows, f"{tmp_path}/out", ["k"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    new = sinks.upsert(rows.dropDuplicates(), spark.createDataFrame([("a", 9)], "k string, v int"), ["k"])
    assert sorted(map(tuple, new.collect())) == [("a", 9), ("b", 2)]
    days = spark.createDataFrame([("2026-01-01 10:00:00", 1), ("2026-01-02 10:00:00", 2)], "ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    sinks.overwrite_days(days, f"{tmp_path}/days", "ts")
    sinks.overwrite_days(days.where("v = 2").withColumn("v", F.lit(3)), f"{tmp_path}/days", "ts")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [1, 3]
