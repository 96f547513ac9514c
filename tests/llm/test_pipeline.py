import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from attestor.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = "river stone garden window letter music paper bread summer winter bottle market forest valley silver".split()
    path, docs, labels = str(tmp_path_factory.mktemp("tables")), [], []
    for i in range(200):
        text = [rnd.choice(words) for _ in range(40)]
        bad, toxic = i % 5 == 1, i % 5 == 2
        text = [w + "###" for w in text] if bad else text
        if toxic:
            text[3] = text[9] = "moron"
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(300, docs[0][1], "en", "s", 1), (301, docs[0][1] + " end", "en", "s", 1), (302, None, None, None, None), (303, "", "en", "s", 0), (0, docs[0][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    bad, toxic = {i for i in range(200) if i % 5 == 1}, {i for i in range(200) if i % 5 == 2}
    assert not bad & set(kept["quality"]) and set(range(200)) - bad <= set(kept["quality"])
    assert not toxic & set(kept["toxicity"]) and set(range(200)) - bad - toxic <= set(kept["toxicity"])
    near = kept["near_duplicates"]
    assert len(near) == len(set(near)) and set(range(200)) - bad - toxic <= set(near) and not {300, 301} & set(near)
    assert docs.where("not round_trip").count() == 0


def test_whole_pipeline_is_registered(spark, folder):
    assert queries.QUERIES["pipeline"](spark, folder).count() > 0
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}


EXTRA = ("score", "_score", "__score", "place", "kept", "copies", "rate", "c0", "decoded", "token_ids", "label", "digest")


def test_clashing_names_long_texts_and_nulls(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(900, "stone river forest " * 50_000, "en", "s", 7), (None, "silver valley " * 20, "en", None, None), (None, None, "zz", None, None)], docs.schema))
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in EXTRA])
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for r in rows for c in EXTRA)
        seen[name] = Counter(r.doc_id for r in rows)
    assert seen["quality"][900] == seen["near_duplicates"][900] == 1
    assert seen["near_duplicates"][None] == seen["toxicity"][None] == seen["quality"][None]
    last = corpus_pipeline.encode(spark, docs, folder)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip"] and last.where("not round_trip").isEmpty()


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_keep_all_good_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == corpus_pipeline.clean(spark, docs, str(tmp_path)).count() == docs.count()
