import json

import pytest
from pyspark.sql import functions as F

from attestor.sources import formats


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def test_front_matter(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("---\ntitle: 'One: x'\ntopics:\n  - a\n---\nBody\n")
    (tmp_path / "two.md").write_text("nothing")
    (tmp_path / "bad.md").write_bytes(b"---\nk: \xff\n---\n")
    (tmp_path / "_hidden.md").write_text("nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("front_matter").load(str(tmp_path)).collect()}
    assert rows.keys() == {"one.md", "two.md", "bad.md"}
    assert rows["one.md"].meta == {"title": ["One: x"], "topics": ["a"]} and rows["one.md"].error is None
    assert rows["two.md"].error == "no front matter" and rows["bad.md"].error
    with pytest.raises(Exception, match="no front matter|decode"):
        spark.read.format("front_matter").option("mode", "strict").load(str(tmp_path)).collect()


@pytest.mark.skipif(formats.yaml is None, reason="no PyYAML")
def test_registries(spark, tmp_path):
    (tmp_path / "a.yml").write_text("sources:\n  - id: s1\n    url: https://a\n    since: 2024-01-02\n  - {id: s2, tags: [x, y]}\nother: 1\n")
    (tmp_path / "b.yaml").write_text("sources: [\n")
    (tmp_path / "c.yaml").write_text("- 1\n")
    (tmp_path / "d.json").write_text(json.dumps({"sources": [{"id": "j"}]}))
    read = lambda **o: spark.read.format("registry").options(array="sources", **o)
    rows = read().load(str(tmp_path)).collect()
    assert sorted(r.error is not None for r in rows) == [False, False, True, True]
    good = formats.parsed(read().load(f"file://{tmp_path}/a.yml"), "item", "id string, since string, tags array<string>")
    assert [tuple(r) for r in good.orderBy("position").select("id", "since", "tags").collect()] == [("s1", "2024-01-02", None), ("s2", None, ["x", "y"])]
    assert read(pattern="*.json").load(str(tmp_path)).first().item == '{"id": "j"}'
    with pytest.raises(Exception, match="b.yaml|c.yaml"):
        read(mode="strict").load(str(tmp_path)).collect()


def test_keyed_state(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"pages": {"u": {"sha": "x"}, "v": {"sha": "y"}}}))
    state = spark.read.format("keyed_state").option("section", "pages").load(str(tmp_path))
    assert sorted(tuple(r) for r in formats.parsed(state, "value", "sha string").select("key", "sha").collect()) == [("u", "x"), ("v", "y")]
    assert spark.read.format("keyed_state").option("section", "none").load(str(tmp_path)).count() == 0


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_ranges_hold_every_line_once(monkeypatch, tmp_path, size):
    monkeypatch.setattr(formats, "PARTITION_BYTES", size)
    (tmp_path / "2024-01-01.jsonl").write_text("".join(json.dumps({"k": k, "t": "é" * (k % 9)}) + ("\r\n" if k % 3 else "\n") for k in range(60)) + '{"k": 60}')
    (tmp_path / "2024-01-02.jsonl").write_text("\n\n" + "x" * 200 + "\n")
    (tmp_path / "notes.jsonl").write_text("no\n")
    reader = formats._LogReader(formats._Options({"path": str(tmp_path)}, "20??-??-??.jsonl"))
    lines = [line for span in reader.partitions() for _, _, line in reader.read(span)]
    assert [json.loads(x)["k"] for x in lines[:-1]] == list(range(61)) and lines[-1] == "x" * 200


def test_corrupt_lines(spark, tmp_path):
    (tmp_path / "2024-01-01.jsonl").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    rows = spark.read.format("dated_log").load(str(tmp_path))
    assert sorted(r.k for r in formats.parsed(rows, "line", "k int").collect()) == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|malformed|broken"):
        formats.parsed(rows, "line", "k int", strict=True).select(F.sum("k")).collect()


def test_stream_reads_what_was_added(spark, tmp_path):
    log, out = tmp_path / "log", f"{tmp_path}/out"
    log.mkdir()
    (log / "2024-01-01.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k"')

    def run():
        rows = formats.parsed(spark.readStream.format("dated_log").load(str(log)), "line", "k int")
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.k for r in spark.read.parquet(out).collect())

    assert run() == [1, 2]
    with (log / "2024-01-01.jsonl").open("a") as f:
        f.write(': 3}\n')
    (log / "2024-01-02.jsonl").write_text('{"k": 4}\n')
    assert run() == [1, 2, 3, 4] and run() == [1, 2, 3, 4]
