"""Files, markup written back, and whole runs."""

import gzip
import html
import json
import random

import pytest
from pyspark.sql import functions as F

from glyphweave.functions import text as tx
from glyphweave.plans import refine as refining
from glyphweave.plans import run
from glyphweave.plans.page import Page
from glyphweave.sources import alto, files, hocr, sinks
from glyphweave.streaming.pages import aligned_pages

WORDS = ["The", "quick", "brcwn", "fox", "jum-", "ps", "over", "it"]
CLEAN = "[BODY]\nThe quick brown fox\n\njumps over it"


def hocr_page(words, extra=""):
    spans = "".join(f"<span class='ocrx_word x' id='w{i}' lang='de' title='bbox {60 * (i % 4)} {80 * (i // 4)} {60 * (i % 4) + 50} {80 * (i // 4) + 20}; x_wconf 90'>{html.escape(w)}</span>" for i, w in enumerate(words))
    return f"<html><head><title>kept</title></head><body><div class='ocr_page' title='image \"a.png\"; bbox 0 0 300 400'><div class='ocr_carea'><p class='ocr_par' id='par'><span class='ocr_line'>{spans}</span></p>{extra}</div></div></body></html>"


def alto_page(words):
    strings = "".join(f'<a:String ID="S{i}" CONTENT="{html.escape(w)}" HPOS="{60 * (i % 4)}" VPOS="{80 * (i // 4)}" WIDTH="50" HEIGHT="20" WC="0.9"/><a:SP/>' for i, w in enumerate(words))
    return f'<a:alto xmlns:a="http://www.loc.gov/standards/alto/ns-v3#"><a:Description>kept</a:Description><a:Layout><a:Page ID="P" HEIGHT="400" WIDTH="300"><a:PrintSpace><a:TextBlock ID="BLOCK_001"><a:TextLine ID="LINE_001_002">{strings}</a:TextLine><a:TextLine ID="none"/></a:TextBlock></a:PrintSpace></a:Page></a:Layout></a:alto>'


def test_all_entities_are_decoded_once(spark):
    texts = ["a &amp;lt; b", "&eacute;&#233;&#xE9;", "&hearts; &#128512; &zzzzz; &", "x&&amp;", "&#0; &#xD800; &copy", "&nbsp;", "plain", "&CounterClockwiseContourIntegral;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.decoded(F.col("t")).alias("t")).collect()
    got = {r.i: r.t for r in rows}
    for i, t in enumerate(texts):
        if i != 4:  # the library also undoes entities that are broken
            assert got[i] == html.unescape(t)
    assert got[4] == texts[4]


def test_classes_are_matched_as_tokens(spark):
    pages = spark.createDataFrame([(1, hocr_page(["a", "b"]) + "<span class='ocrx_wordy' title='bbox 1 1 2 2'>no</span>")], "doc_id long, markup string")
    assert [r.content for r in hocr.words(pages).orderBy("seq").collect()] == ["a", "b"]


def test_hocr_is_written_back_in_place(spark):
    markup = hocr_page(["a", "b<", " ", "d"], "<!-- note -->")
    pages = spark.createDataFrame([(1, markup), (2, markup), (3, "<html></html>")], "doc_id long, markup string")
    aligned = spark.createDataFrame([(1, 0, 1, "A1", 70, 4), (1, 0, 2, "A2", 60, 4), (1, 1, 0, "B & 'c'", 50, None), (1, 3, 0, "", 40, 5)], "doc_id long, seq int, part int, content string, align_conf int, clean_para_id int")
    got = {r.doc_id: r.markup for r in sinks.updated_hocr(pages, aligned).collect()}
    assert got[3] == "<html></html>" and all("<title>kept</title>" in got[i] and "id='par'" in got[i] and "<!-- note -->" in got[i] and got[i].count("lang='de'") == 4 for i in (1, 2))
    assert "x_wconf 90; alignconf 70; cleanpara 4'>A1 A2</span>" in got[1] and "alignconf 50'>B &amp; 'c'</span>" in got[1] and "alignconf 40; cleanpara 5'></span>" in got[1]
    assert got[2].count(f"alignconf {round(90 * 0.35)}'") == 4 and "b&lt;</span>" in got[2]
    assert got[1] == sinks.updated_hocr(spark.createDataFrame([(1, got[1])], "doc_id long, markup string"), aligned).first().markup


def test_alto_is_written_back_in_place(spark):
    pages = spark.createDataFrame([(1, alto_page(["a", "b", "c"])), (2, "<alto/>")], "doc_id long, markup string")
    rows = [(1, 0, 0, "A & b", 0, 0, 50, 20, 90, 0, "a", 0, 81, 2, "body"), (1, 1, 0, "", 60, 0, 50, 20, 90, 0, "b", 0, 81, 2, "body"), (1, 2, 0, "c", 120, 0, 50, 20, 90, None, "c", 1, 22, None, None)]
    aligned = spark.createDataFrame(rows, "doc_id long, seq int, part int, content string, hpos int, vpos int, width int, height int, wc int, tok_seq int, ocr string, reading int, align_conf int, clean_para_id int, layout_tag string")
    got = {r.doc_id: r.markup for r in sinks.updated_alto(pages, aligned).collect()}
    assert got[2] == "<alto/>" and "<a:Description>kept</a:Description>" in got[1] and '<a:TextLine ID="none"/>' in got[1] and "<a:SP/>" not in got[1]
    assert '<a:String ID="WORD_001_002_001" HPOS="0" VPOS="0" WIDTH="110" HEIGHT="20" CONTENT="A &amp; b" WC="90" ALIGNCONF="81" CLEANPARA="2" LAYOUT="body"/><a:String ID="WORD_001_002_002"' in got[1]
    assert [(r.content, r.alignconf) for r in alto.marked_strings(spark.createDataFrame([(1, got[1])], "doc_id long, markup string")).orderBy("seq").collect()] == [("A & b", 81), ("c", 22)]


def test_first_pages(spark, tmp_path):
    two = hocr_page(["a"]).replace("</body>", "<div class='ocr_page' title='bbox 0 0 9 9'><span class='ocrx_word' title='bbox 1 1 2 2'>b</span></div></body>")
    pages = spark.createDataFrame([(1, two)], "doc_id long, markup string")
    assert hocr.words(pages).count() == 2 and hocr.words(hocr.first_page(pages)).count() == 1
    with pytest.raises(Exception, match="holds no page"):
        hocr.first_page(spark.createDataFrame([(1, "<html/>")], "doc_id long, markup string")).collect()
    page = '<Page ID="{0}" PHYSICAL_IMG_NR="{0}"><PrintSpace><TextBlock ID="B"><TextLine ID="L"><String ID="S" CONTENT="w{0}"/></TextLine></TextBlock></PrintSpace></Page>'
    (tmp_path / "p.xml").write_text(f"<alto><Layout>{page.format(10)}{page.format(2)}</Layout></alto>")
    assert [r.content for r in alto.words(alto.first_page(alto.read(spark, str(tmp_path / "p.xml")))).collect()] == ["w2"]


def test_page_files_are_found_by_document(spark, tmp_path):
    for name in ("one/alto/page-10.xml", "one/alto/page-2.xml", "one/hocr/page-1.html", "two/hocr/page-1.html.gz", "two/page-1.txt", "three/scan.hocr", "three/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = [(r.path.split(str(tmp_path))[1], r.kind) for r in files.page_files(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("/one/alto/page-10.xml", "alto"), ("/one/alto/page-2.xml", "alto"), ("/three/scan.hocr", "hocr"), ("/two/hocr/page-1.html.gz", "hocr")]
    assert got.index(("/one/alto/page-2.xml", "alto")) < got.index(("/one/alto/page-10.xml", "alto"))


def test_places_without_one_task_for_all(spark):
    draw = random.Random(1)
    names = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r.id: r.place for r in files.ranked(rows, "place", F.length("name"), F.col("name"), F.col("id")).collect()}
    assert [i for i, _ in sorted(enumerate(names), key=lambda x: (len(x[1]), x[1], x[0]))] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 301))


@pytest.mark.parametrize("kind", ["hocr", "alto"])
def test_a_folder_in_one_call(spark, tmp_path, kind):
    (tmp_path / kind).mkdir()
    for n in (1, 2):
        (tmp_path / kind / (f"page-{n}.html" if kind == "hocr" else f"page-{n}.xml")).write_text((hocr_page if kind == "hocr" else alto_page)(WORDS))
        (tmp_path / f"page-{n}.txt").write_text(CLEAN)
    out = str(tmp_path / "out")
    rows = run.run_all(spark, str(tmp_path), out).collect()
    assert len(rows) == 2 and all(r.matched == 7 and r.error == 0 for r in rows)
    aligned = spark.read.parquet(f"{out}/words").orderBy("doc_id", "seq").limit(8).collect()
    assert [r.content for r in aligned] == ["The", "quick", "brown", "fox", "jumps", "", "over", "it"]
    assert [r.clean_para_id for r in aligned] == [0] * 4 + [1] * 4 and {r.layout_tag for r in aligned} == {"body"}
    markup = spark.read.parquet(f"{out}/markup").first().markup
    assert ("cleanpara 1'>jumps</span>" if kind == "hocr" else 'CONTENT="jumps"') in markup and "kept" in markup
    with pytest.raises(ValueError, match="no page files"):
        run.run_all(spark, str(tmp_path / "out"), out)


def test_packed_and_early_pages_are_aligned_once_their_text_is_there(spark, tmp_path):
    for d in ("scans", "clean", "out"):
        (tmp_path / d).mkdir()
    go = lambda: aligned_pages(spark, str(tmp_path / "scans"), str(tmp_path / "clean"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (tmp_path / "clean/p1.txt").write_text("The quick brown fox jumps over it")
    (tmp_path / "scans/p1.hocr.gz").write_bytes(gzip.compress(hocr_page(WORDS).encode()))
    (tmp_path / "scans/p2.hocr").write_text(hocr_page(["late", "wcrds"]))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    (tmp_path / "clean/p2.txt").write_text("late words")
    (tmp_path / "scans/p3.hocr").write_text(hocr_page(["x"]))
    (tmp_path / "clean/p3.txt").write_text("x")
    go()
    assert {r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"late", "words", "x", "brown"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11


def test_documents_are_refined_whole_or_in_chunks(spark):
    text = "\n".join(f"line {i} of the text goes on here." for i in range(120)) + "\n---\nthe end."
    rows = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    better = lambda q: "TEXT:\n" + (q.partition("PASSAGE:\n")[2] or q.partition("SCAN:\n")[2]).replace("goes", "gaes")
    for page_mode in (True, False):
        got = {r.doc_id: r.text for r in refining.refined_documents(rows, better, page_mode=page_mode).collect()}
        assert got[2] == "short" and got[1].replace("\n\n", "\n") == text.replace("goes", "gaes").replace("\n---", "")
    assert refining.single_chunks(rows).where("doc_id = 1").first().end_line == 121


def boxes(words, per_line=4):
    return [(i, w, 100 * (i % per_line), 60 * (i // per_line), 12 * len(w), 30, 80) for i, w in enumerate(words)]


def test_halves_of_a_word_meet_however_far_apart():
    """Reading order has moved the second half behind 600 other words."""
    filler = [f"word{i}x" for i in range(600)]
    tokens = ["alpha", "sorties", "beta", *filler, "omega"]
    words = ["alpha", "sor-", "beta", *filler, "ties", "omega"]
    rows = Page(boxes(words, 10), tokens).align().rows()
    assert [r[2] for r in rows if r[0] in (1, 603)] == ["sorties", ""]
    blurred = Page(boxes([*words[:-2], "tics", "omega"], 10), tokens).align().rows()
    assert [r[2] for r in blurred if r[0] in (1, 603)] == ["sorties", ""]


def test_short_words_are_settled_by_their_neighbours():
    """What looks like the front of the next word is a word of its own."""
    tokens = "far beyond it ems shine and glow".split()
    words = "far beyond 1t ems shine and glow".split()
    rows = Page(boxes(words), tokens).align().rows()
    assert [r[2] for r in rows] == tokens
    p = Page(boxes(words), tokens)
    reading = p.readings[2]
    assert p.short_word(reading, {r.box: r for r in p.readings}) and reading.candidates[-1].own == [2]


def test_page_height_bounds_the_reach_of_nearness():
    assert Page(boxes(["a"]), ["a"]).height == 30 and Page(boxes(["a"]), ["a"], page_height=900).height == 900


def test_column_and_python_gates_agree(spark):
    """The same rules stand as columns and, for the loop inside a task, in Python."""
    draw = random.Random(4)
    from glyphweave.operators import gates

    vocabulary = ["the", "cat", "sat", "on", "mats", "1234", "dogs", "ran", "it's"]
    pairs = []
    for _ in range(300):
        a = [draw.choice(vocabulary) for _ in range(draw.randint(0, 12))]
        b = [w if draw.random() < 0.85 else draw.choice(["new", "odd", ""]) for w in a]
        pairs.append((" ".join(b), " ".join(a)))
    rows = spark.createDataFrame(pairs, "out string, ocr string")
    got = {(r.out, r.ocr): r.ok for r in gates.all_gates(rows, "out", "ocr").collect()}
    assert all(got[p] == (not refining.objections(*p)) for p in pairs) and len(set(got.values())) == 2
    lines = ["Mr.", "He left.", "pi is 3.14", "a, b", "", "  x  y", "12:30", "word", "vol. 2.", "a" * 61 + " 1"]
    kinds = spark.createDataFrame([(x,) for x in lines], "t string").select("t", tx.sentence_end(F.col("t")).alias("s"), tx.table_line(F.col("t")).alias("l")).collect()
    assert all(r.s == refining.ends_sentence(r.t) and r.l == refining.is_table_line(r.t) for r in kinds)
    texts = ["\n".join(f"{draw.choice(['a', 'item', '7'])}{draw.choice([' 1,', '', ': 22'])}" for _ in range(draw.randint(1, 9))) for _ in range(80)]
    tables = spark.createDataFrame([(x,) for x in texts], "t string").select("t", tx.probable_table(F.col("t")).alias("p")).collect()
    assert all(r.p == refining.probable_table(r.t) for r in tables) and {r.p for r in tables} == {True, False}


def test_reports_over_aligned_pages(spark):
    from glyphweave.operators import candidates, reports
    from glyphweave.plans import align as aligning

    words = spark.createDataFrame([(1, *b) for b in boxes(["The", "quick", "brcwn", "fox", "####"])], "doc_id long, seq int, content string, hpos int, vpos int, width int, height int, wc int")
    words = words.withColumn("norm", tx.normalized(F.col("content")))
    clean = spark.createDataFrame([(1, i, w, w.lower()) for i, w in enumerate("The quick brown fox jumps".split())], "doc_id long, seq int, word string, norm string")
    aligned = aligning.align(words, clean).cache()
    assert [(r.seq, r.word, r.tok_seq, r.conflict, r.left_tok) for r in reports.mapping(aligned, clean).orderBy("seq").collect()][2] == (2, "brown", 2, False, 1)
    assert sum(r.n for r in reports.summary(aligned).collect()) == 5
    quality = aligning.quality(aligned).first()
    assert quality.matched == 5 and quality.match_percent == 100.0
    assert {r.stage for r in aligning.traced(words, clean).collect()} == {"candidates", "first pass", "rounds", "reordered", "weak", "end"}
    assert all(0 <= r.red <= 220 / 255 for r in reports.render_list(aligned).collect())
    best = candidates.best_matches(candidates.fuzzy_candidates(words, clean, 60.0))
    assert {r.bucket: r.n for r in candidates.accuracy_buckets(words, best).collect()} == {"exact": 3, "close": 1, "far": 1}
    assert json.loads(aligned.where("seq = 2").toJSON().first())["ocr"] == "brcwn"
