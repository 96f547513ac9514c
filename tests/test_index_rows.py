from pyspark.sql import functions as F

from attestor.operators import index_rows as X

CANDIDATES = "id string, name string, status string, confidence string, declared string, as_of string, party string, source_url string, source_tier string"
RECORDS = "record string, claim boolean, entity string, title string, path string, source_url string, primary_url string, source_tier string, document_status string, proposal_status string, supersedes array<string>, superseded_by array<string>, source_documents array<string>, published string, first_documented string, verification string, certainty string, topics array<string>"
PIECES = "record string, chunk int, section string, text string"
PARTIES = "id string, name string, website string"


def record(name, claim, entity, **given):
    names = [part.split()[0] for part in RECORDS.split(", ")]
    return tuple({"record": name, "claim": claim, "entity": entity, "path": f"{name}.md", **given}.get(c) for c in names)


def test_one_schema_and_its_rules(spark):
    candidates = spark.createDataFrame([("ann", "Ann", "declared", "medium", None, "2026-05-01", "pa", "u", "t"), ("bob", "Bob", "potential", None, "2026-04-01", None, None, None, None)], CANDIDATES)
    parties = spark.createDataFrame([("pa", "Parti A", "https://a"), ("pb", "Parti B", "")], PARTIES)
    records = spark.createDataFrame(
        [
            record("c1", True, "ann", document_status="current", proposal_status="withdrawn", verification="verified", topics=["retraites", None, ""], source_documents=["d1", ""]),
            record("c2", True, "ann", document_status="amended", title="T", first_documented="2026-01-01", source_url="", primary_url="v"),
            record("c3", True, "pb", published="2026-02-02", first_documented="2026-01-01"),
            record("d1", False, "zed", proposal_status="withdrawn"),
            record("d2", False, None, document_status="archived"),
            record("d3", False, "ann"),
        ],
        RECORDS,
    )
    pieces = spark.createDataFrame([("c1", 0, "s", "x"), ("c1", 1, None, "y"), ("c2", 0, None, "z"), ("c3", 0, None, "z"), ("d1", 0, None, None), ("d2", 0, None, "w"), ("gone", 0, None, "v")], PIECES)
    out = X.assemble(candidates, parties, records, pieces, F.lit("2026-09-09"))
    assert len(out.columns) == 22 and out.columns == list(X.FIELDS)
    rows = {r.id: r for r in out.collect()}
    assert sorted(rows) == sorted(["candidate:ann", "candidate:bob", "party:pa", "party:pb", "c1#1", "c1#2", "c2#1", "c3#1", "d1#1", "d2#1"])
    # a claim's own lifecycle goes first; a document has none
    assert [rows[k].document_status for k in ("c1#1", "c2#1", "c3#1", "d1#1", "d2#1")] == ["withdrawn", "amended", "current", "unknown", "archived"]
    assert (rows["c1#1"].proposal_status, rows["d1#1"].proposal_status) == ("withdrawn", None)
    assert (rows["c1#1"].confidence, rows["c2#1"].confidence, rows["c3#1"].confidence) == ("high", "medium", None)
    assert [rows[k].entity_label for k in ("c1#1", "c3#1", "d1#1", "d2#1")] == ["Ann", "Parti B", "zed", X.UNKNOWN]
    assert (rows["c1#1"].topics, rows["c1#1"].source_documents, rows["c2#1"].supersedes) == (["retraites", "withdrawn"], ["d1"], [])
    assert (rows["c2#1"].source_url, rows["c2#1"].title, rows["c1#2"].title, rows["c1#2"].chunk) == ("v", "T", "c1.md", 1)
    assert (rows["c2#1"].published, rows["c3#1"].published) == ("2026-01-01", "2026-02-02")
    assert [rows[f"candidate:{k}"].published for k in ("ann", "bob")] == ["2026-05-01", "2026-04-01"]
    assert rows["candidate:bob"].text == "Bob. Statut : potential." and rows["candidate:bob"].topics == ["candidat", "candidature", "statut", "potential"]
    assert [(rows[f"party:{k}"].confidence, rows[f"party:{k}"].source_tier, rows[f"party:{k}"].source_url) for k in ("pa", "pb")] == [("high", X.OWN_SITE_TIER, "https://a"), ("medium", None, None)]


def test_nothing_gives_an_empty_index(spark):
    empty = [spark.createDataFrame([], s) for s in (CANDIDATES, PARTIES, RECORDS, PIECES)]
    assert X.assemble(*empty, F.lit("2026-09-09")).count() == 0
