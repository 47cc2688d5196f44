"""What larger tables hold or need: blank texts, batches of many texts, long equal texts."""

import random
import time

import pandas as pd

from glyphweave.functions import similarity
from glyphweave.plans import refine as refining
from glyphweave.queries import QUERIES


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
    return row[-1]


def test_stitched_docs_leave_out_blank_texts_as_the_sql_does(spark, tmp_path):
    rows = [(1, "one two"), (2, ""), (3, "   "), (4, None), (5, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in QUERIES["stitched_docs"](spark, str(tmp_path)).collect()} == {1: "onetwo", 5: ""}


def test_batches_are_taken_in_slices_and_keep_all_rows():
    frame = pd.DataFrame({"doc_id": range(50), "text": ["x" * 100_000] * 49 + [None]})
    parts = list(refining.sliced(frame))
    assert pd.concat(parts)["doc_id"].tolist() == list(range(50)) and max(len(p) for p in parts) <= 12


def test_lcs_equals_the_table_and_long_equal_texts_are_quick():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 12))) for _ in range(2))
        assert similarity.lcs_length(a, b) == plain_lcs(a, b)
    text = "".join(draw.choice("abcdefgh ") for _ in range(400_000))
    began = time.time()
    assert similarity.lcs_length(text, text) == len(text) and similarity.lcs_length(text + "a", text + "b") == len(text)
    assert time.time() - began < 5
