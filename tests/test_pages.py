"""Words and tokens meet within their page's row: against plain Python, and without shuffles of words."""

import random
from collections import Counter

import pytest

from glyphweave.operators import candidates, context, pages
from glyphweave.queries import QUERIES
from glyphweave.sources import derived, hocr, sinks


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["ab", "the", "Eel", "x", "...", "pear-tree"]) for _ in range(n))) for i, n in enumerate((1, 2, 25, 300, 0, 40))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(1).cache()


def plain(docs):
    out = {}
    words, tokens = ({}, {})
    for rows, into in ((derived.ocr_words(docs), words), (derived.clean_tokens(docs), tokens)):
        for r in rows.orderBy("doc_id", "seq").collect():
            into.setdefault(r.doc_id, []).append(r.norm)
    key = lambda l, i: (l[i], l[i - 1] if i else None, l[i + 1] if i + 1 < len(l) else None)
    for d, w in words.items():
        t = tokens[d]
        spots, times, held = {key(t, j): j for j in range(len(t))}, Counter(key(t, j) for j in range(len(t))), {}
        for i in range(len(w)):
            k = key(w, i)
            if times[k] == 1 and k[1:] != (None, None):
                held.setdefault(spots[k], i)
        out |= {(d, i): j for j, i in held.items()}
    return words, tokens, out


@pytest.mark.parametrize("at_once", [1, 200_000])
def test_choices_forms_and_free_tokens_equal_plain_python(docs, monkeypatch, at_once):
    words, tokens, want = plain(docs)
    monkeypatch.setattr(pages, "AT_ONCE", at_once)
    rows = derived.pages(docs)
    assert {(r.doc_id, r.seq): r.tok_seq for r in context.choices_of(rows).collect()} == want
    assert {(r.doc_id, r.seq): r.tok_seq for r in context.perfect_choices(derived.ocr_words(docs), derived.clean_tokens(docs)).collect()} == want
    free = {(d, j) for d, t in tokens.items() for j in range(len(t))} - {(d, j) for (d, _), j in want.items()}
    assert {(r.doc_id, r.seq) for r in pages.untaken(rows).collect()} == free
    forms = {(d, n): ([i for i, x in enumerate(words[d]) if x == n], [j for j, x in enumerate(tokens[d]) if x == n]) for d in words for n in set(words[d]) & set(tokens[d])}
    assert {(r.doc_id, r.norm): (r.seqs, r.tok_seqs) for r in pages.shared_forms(rows).collect()} == forms
    assert {(r.doc_id, r.norm): (r.seqs, r.tok_seqs) for r in candidates.candidate_tokens(derived.ocr_words(docs), derived.clean_tokens(docs)).collect()} == forms


@pytest.mark.parametrize("name", ["align_confidence", "aligned_words", "pending_status", "link_pairs", "missing_neighbours", "unmatched_tokens", "exact_candidates", "candidate_tokens", "word_line_block_ids", "alto_scan", "hocr_roundtrip", "line_items"])
def test_only_texts_are_shuffled(spark, docs, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES[name](spark, str(tmp_path))
    assert rows.count() > 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_writers_skip_places_without_words(spark, docs):
    markup = sinks.hocr(derived.ocr_words(docs.where("doc_id = 2")))
    rows = spark.createDataFrame([(2, 3, 0, "new", 7), (2, 9, 0, "more", 8), (2, 99, 0, "beyond", 9)], "doc_id long, seq long, part int, content string, align_conf int")
    before = {r.seq: r.content for r in hocr.words(markup).collect()}
    after = {r.seq: r.content for r in hocr.words(sinks.updated_hocr(markup, rows)).collect()}
    assert after == before | {3: "new", 9: "more"}


def test_fuzzy_candidates_need_no_shuffle_of_words(spark, tmp_path):
    texts = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu alpha"), (2, " "), (3, None), (4, "élan vital ... beta betas"), (5, "same " * 40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet").where("text is not null")
    own, clean = derived.ocr_words(docs_), derived.clean_tokens(docs_)
    of = lambda rows: sorted((r.doc_id, r.norm, r.clean_form, round(r.score, 6), r.first_seq) for r in rows.collect())
    for cutoff in (60, 80, 90):
        rows = QUERIES[f"fuzzy_candidates_{cutoff}"](spark, str(tmp_path))
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of texts
        assert of(rows) == of(candidates.fuzzy_candidates(own, clean, float(cutoff)))
    best = candidates.best_matches(candidates.fuzzy_candidates(own, clean, 60.0))
    assert of(QUERIES["best_match_top1"](spark, str(tmp_path))) == of(best)
    counts = lambda rows: {r.bucket: (r.n, r.percent) for r in rows.collect()}
    assert counts(QUERIES["ocr_accuracy_buckets"](spark, str(tmp_path))) == counts(candidates.accuracy_buckets(own, best))


def test_line_items_join_no_words(spark):
    from glyphweave import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        plan = queries.QUERIES["line_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gap_scores_join_no_words(spark):
    from glyphweave import queries

    plan = queries.QUERIES["gap_fill_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # with a page's width


def test_linked_columns_equal_linked_pages(spark, docs, tmp_path, monkeypatch):
    draw = random.Random(5)
    odd = [(10, " \n\t "), (11, "É"), (12, "ΑΣ ας ÉTÉ été İ — –x -- x"), (13, " ".join(draw.choice(["Ää", "ä", "...", "Zoë", "e-e", "ΟΔΟΣ"]) for _ in range(200))), (14, None)]
    table = docs.unionAll(spark.createDataFrame(odd, "doc_id long, text string")).repartition(1)
    rows = context.linked_pages(derived.pages(table.where("text is not null")), True)
    rows = derived.boxes(rows, *(c for c in rows.columns if c not in ("doc_id", "seq", "content", "norm", "before"))).select("doc_id", *context.LINKED)
    want = sorted(rows.collect(), key=lambda r: r[:2])
    schema = ", ".join(f"{c} {t}" for c, t in context.LINKED.items())
    for at_once in (1, 200_000):
        monkeypatch.setattr(derived, "AT_ONCE", at_once)
        got = derived.each_read(table, schema, context.linked_columns(*context.LINKED))
        assert got.dtypes == rows.dtypes
        assert sorted(got.collect(), key=lambda r: r[:2]) == want
    table.write.parquet(f"{tmp_path}/documents.parquet")
    links = QUERIES["link_pairs"](spark, str(tmp_path))
    assert sorted(links.collect()) == [(r.doc_id, r.seq, r.seq + 1) for r in want if r.right_linked]
    colours = QUERIES["confidence_colours"](spark, str(tmp_path))
    red = {}
    for r in want:
        red[r.doc_id, r.status] = red.get((r.doc_id, r.status), 0) + (1 - r.wc / 100) * 220 / 255
    assert {(r.doc_id, r.status): r.red for r in colours.collect()} == {k: pytest.approx(v, abs=1e-4) for k, v in red.items()}
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (links, colours)):
        assert "transform(" not in plan  # words are whole columns, not elements of a row's arrays
