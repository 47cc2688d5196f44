import random

import pytest
from made_texts import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with every odd case: nulls, empty, blank, long, repeated rows and shared ids."""
    draw = random.Random(11)
    rows = [(i, "\n".join(prose(draw, draw.randint(3, 90)) for _ in range(draw.randint(1, 4))), "en", f"src{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "en", "src1", 3), (103, "one", "en", "src2", 3), (104, "a b c", "en", None, 5)]
    rows += [(105, prose(draw, 30_000), "en", "src0", 9), rows[3], rows[3], (106, rows[4][1], "en", "src2", 1), (None, "id is null", "en", "src1", 9), (rows[5][0], "same id, other text", "en", "src1", 9)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
