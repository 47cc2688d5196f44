import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphweave.functions import similarity as sim
from glyphweave.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcé", max_size=70), st.text("abcé", max_size=70))
@settings(max_examples=200, deadline=None)
def test_lcs_matches_plain_table(a, b):
    assert sim.lcs_length(a, b) == plain_lcs(a, b)
    assert sim.indel_ratio(a, b) == sim.indel_ratio(b, a)
    assert 0 <= sim.indel_ratio(a, b) <= 100
    assert (sim.indel_ratio(a, b) == 100) == (a == b)


def test_word_ratios_find_all_pairs():
    draw = random.Random(1)
    words = ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 9))) for _ in range(60)] + ["x" * 70, "x" * 69 + "y", ""]
    words = sorted(set(words))
    i, j, r = sim.word_ratios(words, words, 60.0)
    found = {(words[a], words[b]): s for a, b, s in zip(i, j, r)}
    for a in words:
        for b in words:
            want = sim.indel_ratio(a, b)
            assert ((a, b) in found) == (want >= 60)
            if want >= 60:
                assert found[a, b] == pytest.approx(want)


def test_sql_and_arrow_forms_agree(spark):
    rows = spark.createDataFrame([("ab", "ba"), ("kitten", "sitting"), ("", ""), ("", "a"), ("é", "é")], ["a", "b"])
    for r in rows.select("a", "b", sim.indel_ratio_sql(F.col("a"), F.col("b")).alias("x"), sim.indel_ratio_udf("a", "b").alias("y")).collect():
        assert r.x == pytest.approx(r.y) == pytest.approx(sim.indel_ratio(r.a, r.b))


@pytest.mark.parametrize(("word", "norm"), [("Anti-Aircraft!", "anti-aircraft"), ("É1—x", "é1—x"), ("***", ""), ("a_b", "ab")])
def test_normalized(spark, word, norm):
    assert one(spark, tx.normalized(F.col("w")), w=word) == norm


@pytest.mark.parametrize(("word", "ends", "inner"), [("resi-", True, False), ("a-b", False, True), ("- ", True, False), ("—x", False, False), ("x—y", False, True), ("word", False, False)])
def test_hyphens(spark, word, ends, inner):
    assert one(spark, tx.hyphen_ended(F.col("w")), w=word) == ends
    assert one(spark, tx.inner_hyphen(F.col("w")), w=word) == inner


@pytest.mark.parametrize(("line", "ends"), [("He left.", True), ("Dr.", False), ("It is 3.14", False), ("costs 3.5.", True), ("Why?", True), ("no end", False), ("", False), ("by J. Smith Inc.", False)])
def test_sentence_end(spark, line, ends):
    from glyphweave.plans.refine import ends_sentence

    assert one(spark, tx.sentence_end(F.col("x")), x=line) == ends == ends_sentence(line)


@pytest.mark.parametrize(("reply", "decision", "text"), [("DECISION: STOP\nTEXT: done", "STOP", "done"), ("decision continue\nrest", "CONTINUE", "rest"), ("TEXT:only", "CONTINUE", "only"), ("bare", "CONTINUE", "bare")])
def test_replies(spark, reply, decision, text):
    from glyphweave.plans.refine import reply_parts

    assert (one(spark, tx.reply_decision(F.col("r")), r=reply), one(spark, tx.reply_text(F.col("r")), r=reply)) == (decision, text) == reply_parts(reply)


def test_small_text_functions(spark):
    assert one(spark, tx.unescaped(F.col("t")), t="a &amp;lt; &lt;b&gt;") == "a &lt; <b>"
    assert one(spark, tx.squeezed(F.col("t")), t=" a \t b\r\nc ") == "a b\nc"
    assert one(spark, tx.word_count(F.col("t")), t="it's two") == 2
    assert one(spark, tx.without_rules(F.col("t")), t="a\n --- \nb") == "a\nb"
    assert one(spark, tx.with_property(F.col("t"), "alignconf", F.lit(7)), t="bbox 1 2 3 4") == "bbox 1 2 3 4; alignconf 7"
    assert one(spark, tx.with_property(F.col("t"), "alignconf", F.lit(7)), t="alignconf 3") == "alignconf 3"
    assert one(spark, tx.table_line(F.col("t")), t="Total | 12") and not one(spark, tx.table_line(F.col("t")), t="plain words")
    assert one(spark, tx.probable_table(F.col("t")), t="\n".join(f"a {i}, b" for i in range(5)))


def test_word_ratios_bounds_by_characters_lose_no_pair(monkeypatch):
    rng = random.Random(5)
    words = list({"".join(rng.choice("abé漢\U0001f600-") for _ in range(rng.choice([0, 1, 4, 9, 31, 62, 63, 64, 70]))) for _ in range(60)})
    pairs = []
    monkeypatch.setattr(sim, "lcs_pairs", lambda left, right, i, j, of=sim.lcs_pairs: pairs.append(len(i)) or of(left, right, i, j))
    for cutoff in (0.0, 50.0, 60.0, 90.0, 100.0):
        i, j, r = sim.word_ratios(words, sim.Words(words), cutoff)
        want = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if sim.indel_ratio(x, y) >= cutoff}
        assert set(zip(i.tolist(), j.tolist())) == want
    assert pairs[-1] < pairs[0] / 2  # words without the same characters are not compared
