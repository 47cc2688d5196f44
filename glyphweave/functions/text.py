"""Row-wise text functions as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hyphen forms that end a broken word; fixed values.
HYPHENS = ("-", "—", "--")
#: Words that end in a full stop without ending a sentence; fixed values.
ABBREVIATIONS = (
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.",
    "u.s.", "u.k.", "e.g.", "i.e.", "jan.", "feb.", "mar.", "apr.",
    "may.", "jun.", "jul.", "aug.", "sep.", "sept.", "oct.", "nov.", "dec.",
    "etc.", "inc.", "ltd.", "corp.", "co.", "no.", "vol.", "pp.", "p.",
    "a.m.", "p.m.", "am.", "pm.", "serv't", "gen.", "col.", "coln.",
)
#: Words that a refinement may add freely; fixed values.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they",
)
WORD = r"[\p{L}\p{N}_']+"
BARE_WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Blank-separated tokens in order."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalized(word: Column) -> Column:
    """Lower case; letters, numbers and hyphens of any script stay."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}\-–—]", "")


def normalized_words(words: pa.Array) -> pa.Array:
    """The same for an Arrow array, once for each distinct word. Letters that Unicode has since version 14 stay, as they do
    in DuckDB, while ``normalized`` has the Unicode version of the JVM."""
    coded = words.dictionary_encode()
    other = pc.invert(pc.string_is_ascii(coded.dictionary))
    lower = pc.replace_with_mask(pc.ascii_lower(coded.dictionary), other, pa.array([w.lower() for w in coded.dictionary.filter(other).to_pylist()], coded.dictionary.type))
    return pc.replace_substring_regex(lower, r"[^\p{L}\p{N}\-–—]", "").take(coded.indices)


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """The entities that page formats use; the ampersand last, so that one level is undone."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def decoded(text: Column) -> Column:
    """All entities of HTML undone once: named ones, and numbers in either base."""
    names = json.dumps({k: v for k, v in html5.items() if k.endswith(";")})

    def one(piece: Column) -> Column:
        decimal, base16 = F.regexp_extract(piece, r"^#([0-9]{1,7});", 1), F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(decimal != "", decimal.cast("long")).when(base16 != "", F.conv(base16, 16, 10).cast("long"))
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code)), 8, "0")), "UTF-32")
        named = F.element_at(F.from_json(F.lit(names), "map<string,string>"), F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*;)", 1))
        return F.coalesce(F.concat(F.coalesce(char, named), F.regexp_replace(piece, "^[^;]*;", "")), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    whole = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def hyphen_ended(word: Column) -> Column:
    return word.rlike(r"[-—]\s*$")


def inner_hyphen(word: Column) -> Column:
    """A hyphen form inside the word, at neither of its ends."""
    tests = [F.contains(word, F.lit(h)) & ~F.startswith(word, F.lit(h)) & ~F.endswith(word, F.lit(h)) for h in HYPHENS]
    return tests[0] | tests[1] | tests[2]


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(BARE_WORD), F.lit(0)))


def squeezed(text: Column) -> Column:
    """Line ends as line feeds, runs of blanks and tabs as one blank, no edges."""
    unified = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(unified, r"[ \t]+", " "), r"^\s+|\s+$", "")


def sentence_end(line: Column) -> Column:
    """The line closes a sentence: no decimal number, no abbreviation at its end."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    low = F.lower(line)
    short = F.lit(False)
    for a in ABBREVIATIONS:
        short = short | F.endswith(low, F.lit(a))
    return line.rlike(r"[.?!]$") & ~line.rlike(r"\d+\.\d+$") & ~short


def table_line(line: Column) -> Column:
    """Short lines with digits, list signs or gaps look like rows of a table."""
    trimmed = F.trim(line)
    return (trimmed != "") & (F.length(trimmed) <= 60) & trimmed.rlike(r"[0-9,.;:/|]|  ")


def probable_table(text: Column) -> Column:
    """Five lines or more, most of them short, many with digits and signs."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= 35))
    signs = F.size(F.filter(lines, lambda x: x.rlike("[0-9]") & x.rlike(r"[,.;:/|]")))
    return (n >= 5) & (short >= 0.6 * n) & (signs >= 0.4 * n)


def without_rules(text: Column) -> Column:
    """Without lines that are three dashes."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "---"), "\n")


def reply_decision(reply: Column) -> Column:
    found = F.upper(F.regexp_extract(reply, r"(?i)DECISION:?\s*(STOP|CONTINUE)", 1))
    return F.when(found == "", "CONTINUE").otherwise(found)


def reply_text(reply: Column) -> Column:
    """What follows TEXT:, else what follows the decision, else all."""
    labelled = F.regexp_extract(reply, r"(?is)TEXT:\s*(.*)", 1)
    after = F.regexp_extract(reply, r"(?is)DECISION:?\s*(?:STOP|CONTINUE)\s*(.*)", 1)
    return F.trim(F.when(F.trim(labelled) != "", labelled).when(F.trim(after) != "", after).otherwise(reply))


def with_property(title: Column, key: str, value: Column) -> Column:
    """``key value`` appended to a title attribute that doesn't have the key."""
    return F.when(F.contains(F.lower(title), F.lit(key.lower())), title).otherwise(F.concat_ws("; ", F.nullif(title, F.lit("")), F.concat(F.lit(f"{key} "), value.cast("string"))))


def confidence_red(confidence: Column) -> Column:
    """Red share of the colour that shows a confidence of 0 to 100."""
    return (1 - confidence / 100) * 220 / 255


def block_line_ids(word_id: Column) -> tuple[Column, Column]:
    """The block's and the line's id in a word's (WORD_block_line_word); empty if it has another form."""
    parts = F.split(word_id, "_")
    block, line = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    some = F.size(parts) >= 4
    return F.when(some, F.concat(F.lit("BLOCK_"), block)).otherwise(""), F.when(some, F.concat(F.lit("LINE_"), block, F.lit("_"), line)).otherwise("")


def word_id(line_id: Column, number: Column) -> Column:
    """The id of a line's word by its number from 1."""
    parts = F.split(F.replace(line_id, F.lit("LINE_"), F.lit("")), "_")
    return F.concat(F.lit("WORD_"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit("_"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("_"), F.lpad(number.cast("string"), 3, "0"))
