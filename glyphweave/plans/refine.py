"""Refinement of raw OCR text: chunk, refine, validate, stitch.

The refiner is any function from a prompt to a reply; without one, texts come
back as they are. Documents are independent, so the loop runs inside a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import indel_ratio
from ..functions.text import ABBREVIATIONS, STOPWORDS
from ..operators.gates import LEAST_SIMILARITY, LENGTH_TOLERANCE, NOVEL_SHARE, TABLE_LINES

LEAST_WORDS, MOST_WORDS, OVERLAP = 150, 600, 5
CHUNKS = "doc_id long, chunk_id int, text string, start_line int, end_line int, overlap_prefix string, is_table boolean"
DECISION = re.compile(r"DECISION:?\s*(STOP|CONTINUE)", re.I)
LABEL = re.compile(r"TEXT:\s*", re.I)


def count_words(text: str) -> int:
    return len(re.findall(r"\b[\w']+\b", text))


def ends_sentence(line: str) -> bool:
    line = line.strip()
    return bool(re.search(r"[.?!]$", line)) and not re.search(r"\d+\.\d+$", line) and not line.lower().endswith(ABBREVIATIONS)


def is_table_line(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= 60 and bool(re.search(r"[\d|,.;:/]", s) or "  " in s)


def probable_table(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    short = sum(len(x.strip()) <= 35 for x in lines)
    signs = sum(bool(re.search(r"\d", x) and re.search(r"[|,.;:/]", x)) for x in lines)
    return len(lines) >= 5 and short >= 0.6 * len(lines) and signs >= 0.4 * len(lines)


def chunked(text: str, least: int = LEAST_WORDS, most: int = MOST_WORDS, overlap: int = OVERLAP) -> list[dict]:
    """Line ranges that end at a sentence after ``least`` words, or at ``most``;
    the next one starts ``overlap`` lines before the end."""
    lines = text.split("\n")
    out, start = [], 0
    counts = [count_words(x) for x in lines]
    while start < len(lines):
        words, end = 0, start
        for end in range(start, len(lines)):
            words += counts[end]
            if words >= most or words >= least and ends_sentence(lines[end]):
                break
        more = end + 1 < len(lines)
        tail = lines[max(start, end - overlap + 1) : end + 1] if overlap > 0 and more else []
        out.append({"text": "\n".join(lines[start : end + 1]), "start_line": start, "end_line": end, "overlap_prefix": "\n".join(tail), "is_table": False})
        start = max(start + 1, end - overlap + 1) if overlap > 0 and more else end + 1
    return out


def tables_apart(chunks: list[dict], least: int = TABLE_LINES) -> list[dict]:
    """Runs of table lines become chunks of their own."""
    out = []
    for c in chunks:
        lines, at = c["text"].split("\n"), c["start_line"]
        runs, i = [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and is_table_line(lines[j]):
                j += 1
            if j - i >= least:
                runs.append((i, j))
            i = max(j, i + 1)
        done = 0
        for a, b in [*runs, (len(lines), len(lines))]:
            if "\n".join(lines[done:a]).strip():
                last = a == len(lines)
                out.append({"text": "\n".join(lines[done:a]), "start_line": at + done, "end_line": at + a - 1, "overlap_prefix": c["overlap_prefix"] if last else "", "is_table": False})
            if b > a:
                out.append({"text": "\n".join(lines[a:b]), "start_line": at + a, "end_line": at + b - 1, "overlap_prefix": "", "is_table": True})
            done = b
    return out


#: Characters of text that a task holds as rows of Python at a time; a text is never parted.
AT_ONCE = 1_000_000


def sliced(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch, some at a time by the length of their texts, so that memory doesn't grow with the batch."""
    total = frame["text"].str.len().fillna(0).cumsum()
    for _, rows in frame.groupby((total // AT_ONCE).to_numpy(), sort=False):
        yield rows


def chunks(docs: DataFrame, least: int = LEAST_WORDS, most: int = MOST_WORDS, overlap: int = OVERLAP, split_tables: bool = True) -> DataFrame:
    """All chunks of ``docs`` (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for whole in frames for part in sliced(whole)):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                found = chunked(text or "", least, most, overlap)
                found = tables_apart(found) if split_tables else found
                rows += [(doc_id, k, c["text"], c["start_line"], c["end_line"], c["overlap_prefix"], c["is_table"]) for k, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, CHUNKS)


def single_chunks(docs: DataFrame) -> DataFrame:
    """Each text as one chunk, as pages are refined."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("start_line"),
        (F.size(F.split(F.coalesce("text", F.lit("")), "\n")) - 1).alias("end_line"), F.lit("").alias("overlap_prefix"), F.lit(False).alias("is_table"),
    )


def stitched(parts: DataFrame, text: str = "text", compat: bool = False) -> DataFrame:
    """(doc_id, text): chunks in order without the lines that repeat those of
    chunks before. ``compat`` takes the number of lines from the chunk's own
    overlap, as older output does, which leaves the last chunk's repeated lines
    in. Refined texts are expected to keep their lines."""
    one = F.struct("chunk_id", F.col(text).alias("t"), F.col("overlap_prefix").alias("o"), "start_line", "end_line")
    rows = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("c"))
    filled = lambda s: F.size(F.filter(F.split(s, "\n"), lambda x: F.trim(x) != ""))

    def kept(x, i):
        done = F.array_max(F.transform(F.slice("c", 1, i), lambda y: y["end_line"]))
        repeated = F.when(x["o"] == "", 0).otherwise(filled(x["o"])) if compat else done - x["start_line"] + 1
        lines = F.split(x["t"], "\n")
        k = F.least(F.greatest(repeated, F.lit(0)), F.size(lines))
        return F.when(i == 0, x["t"]).otherwise(F.array_join(F.slice(lines, k + 1, F.size(lines) - k), "\n"))

    cleaned = F.filter(F.transform("c", kept), lambda s: F.trim(s) != "")
    return rows.select("doc_id", F.array_join(cleaned, "\n\n").alias("text"))


# one chunk


def reply_parts(reply: str) -> tuple[str, str]:
    m = DECISION.search(reply)
    decision = m[1].upper() if m else "CONTINUE"
    label = LABEL.search(reply)
    text = reply[label.end() :].strip() if label else ""
    return decision, text or (reply[m.end() :].strip() if m else "") or reply.strip()


def squeezed(text: str) -> str:
    return re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def objections(out: str, ocr: str, tolerance: float = LENGTH_TOLERANCE) -> list[str]:
    """Gates that a refined text fails."""
    a, b = squeezed(out), squeezed(ocr)
    found = []
    for x, y in ((count_words(a), count_words(b)), (len(a), len(b))):
        if (abs(x / y - 1) > tolerance) if y else x > 0:
            found.append("length")
            break
    words, known = set(re.findall(r"\b\w+\b", a.lower())), set(re.findall(r"\b\w+\b", b.lower()))
    novel = [w for w in words - known if w not in STOPWORDS and not w.isdigit()]
    if words and len(novel) / len(words) > NOVEL_SHARE:
        found.append("novel words")
    if indel_ratio(a, b) < LEAST_SIMILARITY:
        found.append("similarity")
    return found


def prompt(text: str, ocr: str, table: bool, strict: bool) -> str:
    parts = [
        "Correct recognition errors in the passage. Keep wording, order and line breaks; add nothing.",
        "Keep the columns and numbers of the table as they are." if table else "",
        "Your last answer changed too much: change single characters only." if strict else "",
        f"The scan has {count_words(ocr)} words and {len(ocr)} characters; stay within {LENGTH_TOLERANCE:.0%}.",
        "Answer with DECISION: STOP or CONTINUE, then TEXT: and the passage.",
        f"SCAN:\n{ocr}",
        f"PASSAGE:\n{text}" if text != ocr else "",
    ]
    return "\n\n".join(p for p in parts if p)


def refine_chunk(ocr: str, refiner: Callable[[str], str], table: bool = False, rounds: int = 6) -> tuple[str, int, list[str]]:
    """(text, rounds used, last objections). A refused answer gets one stricter
    try; after that the last good text stands."""
    text, objected = ocr, []
    for n in range(1, rounds + 1):
        for strict in (False, True):
            decision, answer = reply_parts(refiner(prompt(text, ocr, table, strict)))
            objected = objections(answer, ocr)
            if not objected:
                break
        if objected:
            return text, n, objected
        stable = squeezed(answer) == squeezed(text)
        text = answer
        if decision == "STOP" or stable:
            return text, n, []
    return text, rounds, []


def identity(question: str) -> str:
    """A refiner that gives the passage back."""
    passage = question.partition("PASSAGE:\n")[2] or question.partition("SCAN:\n")[2]
    return f"DECISION: STOP\nTEXT:\n{passage}"


REFINED = f"{CHUNKS}, refined string, rounds int, objections array<string>"


def refine_chunks(parts: DataFrame, refiner: Callable[[str], str] = identity, rounds: int = 6) -> DataFrame:
    """Chunks with their refined text; a failing refiner leaves a chunk as it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part.copy() for whole in frames for part in sliced(whole)):
            rows = []
            for text, table in zip(frame["text"], frame["is_table"], strict=True):
                try:
                    rows.append(refine_chunk(text, refiner, table or probable_table(text), rounds))
                except Exception as e:  # the refiner is foreign code, and one chunk shall not end the job
                    rows.append((text, 0, [type(e).__name__]))
            column = lambda values: pd.Series(values, index=frame.index, dtype=object)  # noqa: B023, E731
            frame["refined"] = column([r[0] or t for r, t in zip(rows, frame["text"], strict=True)])
            frame["rounds"], frame["objections"] = column([r[1] for r in rows]), column([r[2] for r in rows])
            yield frame

    return parts.mapInPandas(run, REFINED)


def refine(docs: DataFrame, refiner: Callable[[str], str] = identity, rounds: int = 6, **sizes: int) -> DataFrame:
    """Every chunk of ``docs`` with its refined text."""
    return refine_chunks(chunks(docs, **sizes), refiner, rounds)


def refined_documents(docs: DataFrame, refiner: Callable[[str], str] = identity, rounds: int = 6, page_mode: bool = False, **sizes: int) -> DataFrame:
    """(doc_id, text): chunked (``page_mode``: one chunk a text), refined, stitched, without lines of dashes."""
    parts = single_chunks(docs) if page_mode else chunks(docs, **sizes)
    whole = stitched(refine_chunks(parts, refiner, rounds), "refined")
    return whole.select("doc_id", tx.without_rules(F.col("text")).alias("text"))
