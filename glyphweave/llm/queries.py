"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    mpeg_audio,
    pii_boosting,
    prob_minhash,
    quality_crf,
    secret_forest,
    spaced_seeds,
    suffix_tree_lm,
    toxicity_ordinal,
    trie_tokens,
    water_filling,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_lm": suffix_tree_lm.op1,
    "op2_mpeg_audio": mpeg_audio.op2,
    "op3_secret_forest": secret_forest.op3,
    "op4_toxicity_ordinal": toxicity_ordinal.op4,
    "op5_spaced_seeds": spaced_seeds.op5,
    "op6_pii_boosting": pii_boosting.op6,
    "op7_quality_crf": quality_crf.op7,
    "op8_trie_tokens": trie_tokens.op8,
    "op9_prob_minhash": prob_minhash.op9,
    "op10_water_filling": water_filling.op10,
}

def part(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """The columns of a query that SQL can express."""
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).select(*columns)


QUERIES |= {
    "lm_base_scores": lambda spark, sf_dir: suffix_tree_lm.base_scores(spark, sf_dir).withColumn("base_score", F.round("base_score", 4)),
    "audio_payloads": part("op2_mpeg_audio", "doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
    "personal_data_counts": part("op6_pii_boosting", "doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    "quality_fold": part("op7_quality_crf", "doc_id", "held_out"),
    "word_counts": part("op8_trie_tokens", "doc_id", "n_words"),
}


def crc32(text: str) -> str:
    """SQL of a short ASCII text's checksum, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}), 4294967295::BIGINT)"


KEY = "coalesce(doc_id::VARCHAR, '')"
WORDS = r"regexp_extract_all(regexp_replace({0}, '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substring(reverse({DIGITS}), i, 1)::INT ELSE substring('0246813579', substring(reverse({DIGITS}), i, 1)::INT + 1, 1)::INT END)) % 10 = 0"

ORACLES: dict[str, str] = {
    "op10_water_filling": water_filling.ORACLE,
    "lm_base_scores": f"""WITH d AS (SELECT doc_id, {crc32(KEY)} % 7 = 2 AS held_out, list_append({WORDS.format(LOWER)}, chr(10)) AS w FROM documents),
t AS MATERIALIZED (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM d WHERE NOT held_out) GROUP BY w),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM t),
e AS (SELECT row_number() OVER () AS r, * FROM d),
s AS (SELECT r, any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(t.c) AS n_known, sum(log10(coalesce(t.c, 0) + 1.0)) AS s FROM (SELECT r, doc_id, held_out, unnest(w) AS w FROM e) x LEFT JOIN t USING (w) GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, round(s - n_tokens * log10(n.n + n.v + 1.0), 4)::DOUBLE AS base_score FROM s, n""",
    "audio_payloads": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 576 ELSE (576 - octet_length(b) % 576) % 576 END AS k FROM d)
SELECT doc_id, n AS n_bytes, n + k AS payload_bytes, sha256(b || unhex(repeat('FF', k))) AS payload_sha256 FROM p""",
    "personal_data_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255)) AS n_ip,
  len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN})) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({DIGITS}) BETWEEN 9 AND 15)) AS n_phone FROM d""",
    "quality_fold": f"SELECT doc_id, {crc32(KEY)} % 4 = 2 AS held_out FROM documents",
    "word_counts": f"SELECT doc_id, len({WORDS.format("coalesce(text, '')")}) AS n_words FROM documents",
}
