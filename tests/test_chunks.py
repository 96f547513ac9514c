from attestor.operators import chunks


def test_chunks_are_aligned_to_sentences():
    text = "# One\n" + " ".join(f"Sentence number {k} is here." for k in range(60)) + "\n## Two\nShort text."
    out = chunks.cut(text, 300, 80)
    assert all(len(c) <= 300 for _, c in out) and {s for s, _ in out} == {"One", "Two"}
    for (_, a), (s, b) in zip(out, out[1:], strict=False):
        if s == "One":
            tail = chunks.sentence_tail(a, 80)
            assert tail and b.startswith(tail)
    assert out[-1] == ("Two", "Short text.") and chunks.cut("", 300, 80) == []


def test_every_sentence_is_in_a_chunk(spark):
    text = " ".join(f"Fact {k} stands." for k in range(500))
    rows = chunks.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "doc_id", "text", 200, 50).collect()
    joined = " ".join(r.chunk for r in rows)
    assert all(f"Fact {k} stands." in joined for k in range(500)) and {r.doc_id for r in rows} == {1}


def test_windows_cover_the_text(spark):
    text = "Repeated sentence here. " * 1200
    rows = chunks.windows(spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "doc_id long, text string"), "doc_id", "text", 5000, 200).orderBy("doc_id", "pos").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) > 2 and one[0].start == 0 and one[-1].start + len(one[-1].window) == len(text)
    assert all(r.window == text[r.start : r.start + len(r.window)] and 0 < len(r.window) <= 5000 for r in one)
    assert all(b.start == a.start + len(a.window) - 200 for a, b in zip(one, one[1:], strict=False))
    assert [(r.doc_id, r.window) for r in rows if r.doc_id > 1] == [(2, "short")]
