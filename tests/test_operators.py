import random

import pytest
from pyspark.sql import functions as F

from glyphweave.functions.similarity import indel_ratio
from glyphweave.operators import candidates, context, gates, geometry, words
from glyphweave.plans import align as aligning
from glyphweave.plans import refine as refining
from glyphweave.plans.page import Page
from glyphweave.sources import alto, derived, hocr, sinks


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefgeé") for _ in range(draw.randint(2, 9))) for _ in range(80)]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate((1, 40, 120, 300))]
    return spark.createDataFrame([*rows, (9, ""), (10, None)], "doc_id long, text string").cache()


def test_fuzzy_candidates_match_brute_force(docs):
    ocr, clean = derived.ocr_words(docs), derived.clean_tokens(docs)
    found = {(r.doc_id, r.norm, r.clean_form): r.score for r in candidates.fuzzy_candidates(ocr, clean, 70.0).collect()}
    want = {}
    vocab = {}
    for r in clean.collect():
        vocab.setdefault(r.doc_id, set()).add(r.norm)
    for r in ocr.select("doc_id", "norm").distinct().collect():
        own = vocab[r.doc_id]
        for v in [r.norm] if r.norm in own else own:
            if indel_ratio(r.norm, v) >= 70:
                want[r.doc_id, r.norm, v] = indel_ratio(r.norm, v)
    assert found == pytest.approx(want)


def test_pages_without_any_match(spark):
    words_ = spark.createDataFrame([(1, 0, "xxxx"), (2, 0, "abcd")], "doc_id long, seq int, norm string")
    clean = spark.createDataFrame([(1, 0, "mmmm"), (2, 0, "abcx"), (3, 0, "abcd")], "doc_id long, seq int, norm string")
    assert [(r.doc_id, r.clean_form, r.score) for r in candidates.fuzzy_candidates(words_, clean, 60.0).collect()] == [(2, "abcx", 75.0)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert refining.refine(none).count() == 0 and aligning.align(derived.ocr_words(none), derived.clean_tokens(none)).count() == 0


def test_best_match_prefers_score_then_order(spark):
    rows = spark.createDataFrame([(1, "a", "x", 80.0, 5), (1, "a", "y", 90.0, 9), (1, "a", "z", 90.0, 3)], "doc_id long, norm string, clean_form string, score double, first_seq long")
    assert candidates.best_matches(rows).first().clean_form == "z"


def test_alignment_equals_the_kernel_page_by_page(spark, docs):
    ocr, clean = derived.ocr_words(docs), derived.clean_tokens(docs)
    got = {}
    for r in aligning.align(ocr, clean).collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.part, r.content, r.tok_seq, r.status))
    words_of, tokens_of = {}, {}
    for r in ocr.orderBy("doc_id", "seq").collect():
        words_of.setdefault(r.doc_id, []).append((r.seq, r.content, r.hpos, r.vpos, r.width, r.height, r.wc))
    for r in clean.orderBy("doc_id", "seq").collect():
        tokens_of.setdefault(r.doc_id, []).append(r.word)
    assert set(got) == set(words_of)
    for page in got:
        want = [(r[0], r[1], r[2], r[8], r[9]) for r in Page(words_of[page], tokens_of[page]).align().rows()]
        assert sorted(got[page], key=lambda r: r[:2]) == want
    spread = aligning.align(ocr.repartition(7), clean.repartition(3)).orderBy("doc_id", "seq", "part").collect()
    assert spread == aligning.align(ocr, clean).orderBy("doc_id", "seq", "part").collect()


def test_confidence_factors(spark):
    rows = spark.createDataFrame([(90, True, False, False, True), (90, True, True, False, True), (90, False, False, True, False), (90, False, False, False, True), (90, False, False, False, False), (5, True, True, False, True)], "wc int, c boolean, p boolean, f boolean, h boolean")
    assert [r.x for r in rows.select(context.align_confidence(*[F.col(c) for c in ("wc", "c", "p", "f", "h")]).alias("x")).collect()] == [90, 54, 22, 40, 18, 3]


def test_clusters_use_upper_medians(spark):
    rows = spark.createDataFrame([(1, "left", p) for p in (0, 0, 99, 198, 500, 560)], "doc_id long, side string, position long")
    assert [(r.n, r.edge) for r in geometry.edge_clusters(rows).orderBy("cluster").collect()] == [(4, 99), (2, 560)]


def test_width_fit_edges(spark):
    rows = spark.createDataFrame([(100.0, 135.0), (100.0, 136.0), (100.0, 64.0), (0.0, 5.0), (100.0, 500.0)], "w double, e double")
    assert [round(r.x, 6) for r in rows.select(geometry.width_fit(F.col("w"), F.col("e")).alias("x")).collect()] == [100, 28, 28, 0, 0]


def test_hocr_and_alto_round_trips(spark, docs):
    ocr = derived.ocr_words(docs).withColumn("content", F.when(F.col("seq") == 3, F.lit('<a> & "b"')).otherwise(F.col("content")))
    columns = ["doc_id", "seq", "content", "hpos", "vpos", "width", "height", "wc"]
    want = sorted(ocr.select(*columns).collect())
    assert sorted(hocr.words(sinks.hocr(ocr)).select(*columns).collect()) == want


def test_alto_file(spark, tmp_path, docs):
    ocr = derived.ocr_words(docs.where("doc_id = 2"))
    (tmp_path / "p.xml").write_text(sinks.alto(ocr).first().markup, encoding="utf-8")
    columns = ["seq", "content", "hpos", "vpos", "width", "height"]
    got = alto.words(alto.read(spark, str(tmp_path / "p.xml"))).select(*columns, "wc").orderBy("seq").collect()
    assert [r[:6] for r in got] == [tuple(r) for r in ocr.select(*columns).orderBy("seq").collect()]
    assert all(40 <= r.wc <= 100 for r in got)
    (tmp_path / "q.xml").write_text(
        '<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Layout><Page ID="P" WIDTH="9" HEIGHT="9"><PrintSpace><ComposedBlock ID="C"><TextBlock ID="B"><TextLine ID="L">'
        '<String ID="S" CONTENT="a &amp;amp; b" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4" WC="0.96"/><String ID="T" CONTENT="x" WC="bad"/></TextLine></TextBlock></ComposedBlock></PrintSpace></Page></Layout></alto>'
    )
    assert [(r.content, r.hpos, r.wc) for r in alto.words(alto.read(spark, str(tmp_path / "q.xml"))).orderBy("seq").collect()] == [("a &amp; b", 1, 96), ("x", 0, 0)]


def test_hocr_keys_survive_blank_words(spark):
    markup = """<div class="ocr_page" title="bbox 0 0 100 200"><div class='ocr_carea'><span class='ocr_header' id='l'>
    <span class='ocrx_word' id='a' title='bbox 1 2 3 4; x_wconf 11'> </span><span class="ocrx_word" id="b" title="bbox 5 6 9 9; x_wconf 93"><b>No.</b></span></span></div></div>"""
    rows = hocr.words(spark.createDataFrame([(1, markup)], "doc_id long, markup string")).collect()
    assert [(r.seq, r.word_id, r.content, r.hpos, r.width, r.wc) for r in rows] == [(1, "b", "No.", 5, 4, 93)]


def test_combined_hocr(spark):
    page = "<html><head>h</head><body><div class='ocr_page' id='{}'>x</div></body></html>"
    rows = spark.createDataFrame([(1, 2, page.format("b")), (1, 1, page.format("a"))], "doc long, page_no int, markup string")
    out = sinks.combined_hocr(rows, "doc", "page_no").first().markup
    assert out.count("ocr_page") == 2 and out.index("'a'") < out.index("'b'") and out.count("<head>") == 1


def test_chunks_cover_all_lines_and_stitch_back(spark):
    draw = random.Random(2)
    text = "\n".join(" ".join(["word"] * draw.randint(1, 60)) + draw.choice([".", "", " 3"]) for _ in range(120)) + "\na 1\nb 2\nc 3"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    plain = refining.chunks(rows, split_tables=False)
    assert refining.stitched(plain).first().text.replace("\n\n", "\n") == text
    split = refining.chunks(rows)
    assert split.where("is_table").count() >= 1
    assert refining.stitched(split).first().text.replace("\n\n", "\n") == text
    first = plain.orderBy("chunk_id").first()
    assert first.start_line == 0 and refining.count_words(first.text) >= 150


def test_refining_keeps_the_last_good_text(spark):
    assert refining.refine_chunk("The cat sat here today.", lambda q: "DECISION: STOP\nTEXT:\nThe cat sat here today.") == ("The cat sat here today.", 1, [])
    text, rounds, objected = refining.refine_chunk("The cat sat.", lambda q: "TEXT: entirely different words of another kind altogether")
    assert text == "The cat sat." and rounds == 1 and objected
    rows = spark.createDataFrame([(1, "One line of text.")], "doc_id long, text string")

    def broken(question):
        raise RuntimeError("down")

    out = refining.refine(rows, broken).first()
    assert out.refined == "One line of text." and out.objections == ["RuntimeError"]


def test_gates(spark):
    rows = spark.createDataFrame([("a b c", "a b c"), ("a b c d e f", "a b c"), ("totally new words here", "a b c d"), ("", "")], "out string, ocr string")
    got = gates.all_gates(rows, "out", "ocr").collect()
    assert [r.ok for r in got] == [True, False, False, True]


def test_set_form_agrees_with_kernel_on_clean_pages(spark, docs):
    clean = derived.clean_tokens(docs)
    same = clean.withColumn("content", F.col("word")).withColumn("wc", F.lit(80))
    for r in context.linked(same, clean).where("tok_seq is not null").collect():
        assert r.seq == r.tok_seq


def test_layout_and_paragraphs(spark):
    rows = spark.createDataFrame([(1, "[ARTICLE 1 TITLE]\nHello there\n\n\nnext part\n[BODY]\nx")], "doc_id long, text string")
    assert [(r.text, r.layout_tag) for r in words.layout_lines(rows).orderBy("line").collect()] == [("Hello there", "article_1_title"), ("", "article_1_title"), ("", "article_1_title"), ("next part", "article_1_title"), ("x", "body")]
    assert [r.para_id for r in words.paragraph_tokens(rows).orderBy("seq").select("para_id").distinct().orderBy("para_id").collect()] == [0, 1]


def test_pages_align_as_they_arrive(spark, tmp_path):
    from glyphweave.streaming.pages import aligned_pages

    for d in ("scans", "clean", "out"):
        (tmp_path / d).mkdir()
    spans = "".join(f"<span class='ocrx_word' id='w{i}' title='bbox {50 * i} 0 {50 * i + 40} 20; x_wconf 90'>{w}</span>" for i, w in enumerate(["The", "quick", "brcwn", "fox"]))
    (tmp_path / "scans/p1.hocr").write_text(f"<html><body><div class='ocr_page' title='bbox 0 0 900 900'><div class='ocr_carea'><span class='ocr_line'>{spans}</span></div></div></body></html>")
    (tmp_path / "clean/p1.txt").write_text("The quick brown fox")
    run = lambda: aligned_pages(spark, str(tmp_path / "scans"), str(tmp_path / "clean"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r.content for r in rows] == ["The", "quick", "brown", "fox"]
    run()  # nothing new
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
