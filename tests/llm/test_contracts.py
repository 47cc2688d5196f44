"""What all ten operators promise: any column names, any ids, empty tables, and
results that brute force gives."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest
from made_texts import prose
from pyspark.sql import functions as F
from test_media_and_pairs import edited, partition, shingled, similarity

from glyphweave.llm import components as comps
from glyphweave.llm import mpeg_audio as mpeg
from glyphweave.llm import pii_boosting as pii
from glyphweave.llm import prob_minhash as near
from glyphweave.llm import quality_crf as crf
from glyphweave.llm import secret_forest as secrets
from glyphweave.llm import spaced_seeds as seeds
from glyphweave.llm import suffix_tree_lm as lm
from glyphweave.llm import toxicity_ordinal as toxicity
from glyphweave.llm import trie_tokens as trie
from glyphweave.llm import water_filling as mix

#: Names of columns that the operators use inside.
CLASHING = (
    "spans", "base_spans", "base", "wide", "likely", "searched", "key", "y", "h", "__order", "__source", "__bucket", "__whole", "__digest", "__gone", "__id", "__p", "__hit", "__bits",
    "digest", "stays", "gone0", "c0", "c1", "c99", "hit_id", "item_id", "item", "pos", "seed", "shift", "band", "component", "node", "score", "severity", "quality", "toxic",
    "held", "kind", "part", "pid", "blob", "media", "payload", "n_bytes", "n_words", "Text2", "size2",
)


@pytest.fixture(scope="module")
def clashing(spark):
    draw = random.Random(2)
    rows = []
    for i in range(80):
        text = [f"{prose(draw, 30)} name{i}@mail.example.org", prose(draw, 40), None, ""][min(i % 9, 3) if i % 9 > 6 else i % 2]
        rows.append((i, text, f"s{i % 3}", *([i] * len(CLASHING))))
    rows += [rows[0], rows[0], (200, rows[4][1], "s1", *([200] * len(CLASHING)))]
    names = ["doc_id", "text", "source", *CLASHING]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, schema).select(*names[3:], *names[:3])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")


def same_but_text(table, out, redact=False):
    keep = [c for c in table.columns if not (redact and c == "text")]
    known = {tuple(r) for r in table.select(*keep).collect()}
    return all(tuple(r) in known for r in out.select(*keep).collect())


def test_columns_of_any_name_pass_through(spark, clashing, labels):
    bench = spark.createDataFrame([(1, clashing.where("doc_id = 3").first().text)], "item_id long, text string")
    for out in (near.keep_one_of_each(clashing), seeds.without_leaks(clashing, bench), crf.keep_good(clashing, labels)):
        assert out.columns == clashing.columns and same_but_text(clashing, out) and out.count() > 0
    out = pii.redacted(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count() and same_but_text(clashing, out, redact=True)
    assert out.where("text like '%[EMAIL]%'").count() == clashing.where("text like '%@%'").count() > 0
    mixed = mix.water_filling_mix(clashing)
    assert mixed.columns == [*clashing.columns, "size", "source_size", "target", "taken"] and same_but_text(clashing, mixed)
    found = pii.spans(clashing)
    assert found.columns == [*(c for c in clashing.columns if c not in ("spans", "base_spans")), "base_spans", "spans"]
    keep = ["doc_id", "c0", "c1", "__hit", "payload", "part"]
    for out in (crf.quality_scores(clashing, labels, keep), toxicity.toxicity_scores(clashing, labels, keep), trie.token_counts(clashing, keep), mpeg.store_as_audio(clashing, "text", keep)):
        assert out.columns[: len(keep)] == keep and same_but_text(clashing.select(*keep), out.select(*keep)) and out.count() == clashing.count()
    for out in (lm.suffix_tree_scores(clashing), near.near_duplicates(clashing)):
        assert out.count() == clashing.count()
    assert secrets.secret_findings(clashing).count() > 0 and seeds.leaks(clashing, bench).count() == 1


def test_ids_may_be_texts(spark, clashing, labels):
    table = clashing.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "source")
    own = labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    ids = sorted(r.doc_id for r in table.collect())
    same = lambda df: sorted(r.doc_id for r in df.collect()) == ids
    assert same(lm.suffix_tree_scores(table)) and same(near.near_duplicates(table)) and same(pii.spans(table)) and same(mix.water_filling_mix(table))
    assert same(crf.quality_scores(table, own, ["doc_id"])) and same(toxicity.toxicity_scores(table, own, ["doc_id"])) and same(trie.token_counts(table, ["doc_id"]))
    assert {r.doc_id for r in secrets.secret_findings(table).collect()} <= set(ids)
    bench = spark.createDataFrame([("i", table.where("doc_id = 'd3'").first().text)], "item_id string, text string")
    assert [tuple(r)[:2] for r in seeds.leaks(table, bench).collect()] == [("d3", "i")]


def test_empty_tables(spark, no_docs, tmp_path):
    import corpus_pipeline as pipeline

    bench = spark.createDataFrame([(1, "x " * 20)], "item_id long, text string")
    stored = mpeg.store_as_audio(no_docs, "text", ["doc_id"])
    assert stored.count() == mpeg.parse_audio(stored).count() == 0
    for out in (seeds.without_leaks(no_docs, bench), near.keep_one_of_each(no_docs), pii.redacted(no_docs), mix.water_filling_mix(no_docs)):
        assert out.count() == 0
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_ties_and_repeats_have_one_result(spark):
    """Equal rows, equal ids with different texts, and equal spans: reruns agree."""
    draw = random.Random(8)
    texts = [prose(draw, 30) for _ in range(6)]
    rows = [(i // 2, texts[i % 6], "s") for i in range(36)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shuffled = table.repartition(7)
    for f in (near.near_duplicates, near.keep_one_of_each, lm.suffix_tree_scores, mix.water_filling_mix, pii.redacted):
        one, two = (sorted(map(str, f(t).collect())) for t in (table, shuffled))
        assert one == two
    assert near.keep_one_of_each(table).count() == 6


# brute force


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def leaks_by_brute_force(docs, items):
    found = set()
    for d, text in docs:
        a = tokens(text)
        for k, item in items:
            b = tokens(item)
            window, allowed = min(seeds.WINDOW, len(b)), 0 if len(b) < seeds.SPAN else seeds.MISSES
            for shift in range(-len(b) + 1, len(a)):
                pairs = [(a[i], b[i - shift]) for i in range(max(0, shift), min(len(a), shift + len(b)))]
                if b and any(sum(x != y for x, y in pairs[i : i + window]) <= allowed for i in range(len(pairs) - window + 1)):
                    found.add((d, k))
                    break
    return found


@pytest.mark.parametrize("broadcast", [seeds.BROADCAST, 0])
def test_leaks_match_brute_force(spark, broadcast):
    draw = random.Random(23)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(draw.choice(words) for _ in range(n))) for k, n in enumerate((13, 14, 20, 35, 59, 12, 11, 10, 9, 5, 2))]
    docs = []
    for i in range(150):
        item = items[i % len(items)][1].split()
        n = min(len(item), draw.choice([9, 13, 16, 40]))
        at = draw.randrange(len(item) - n + 1)
        piece = item[at : at + n]
        for spot in draw.sample(range(n), min(n, draw.randint(0, 4))):
            piece[spot] = draw.choice(words)
        docs.append((i, " ".join([draw.choice(words) for _ in range(draw.randint(0, 12))] + piece + [draw.choice(words) for _ in range(draw.randint(0, 12))])))
    want = leaks_by_brute_force(docs, items)
    got = seeds.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 60


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables aren't here")
def test_recall_of_near_duplicates_on_a_whole_table(spark):
    """Every pair of different texts at or above the threshold shares a class, on all documents."""
    rows = near.op9(spark, "/root/testdata/sf0.01").collect()
    class_of = {r.doc_id: r.class_id for r in rows}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    sets = {i: shingled(t) for t, i in first.items()}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = Counter()
    for ids in index.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[min(a, b), max(a, b)] += 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.5 * min(len(sets[a]), len(sets[b])) and similarity(sets[a], sets[b]) >= near.THRESHOLD]
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, t in texts.items():
        root[find(i)] = find(first[t])
    for a, b in pairs:
        root[find(a)] = find(b)
    assert len(pairs) >= 5 and all(class_of[a] == class_of[b] for a, b in pairs)
    assert partition(texts, [class_of[i] for i in texts]) == partition(texts, [find(i) for i in texts])


def test_strays_in_a_bucket_of_copies_are_settled(spark, monkeypatch):
    """Blocks of a bucket's largest class meet the others', which meet each other."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near, "TURNS", 1)
    draw = random.Random(19)
    origin = prose(draw, 80)
    texts = [edited(draw, origin, 1) for _ in range(60)] + [edited(draw, origin, k) for k in (3, 4, 5, 6, 7, 8) for _ in range(4)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.near_duplicates(table).collect()}
    from test_media_and_pairs import classes_of

    assert partition(range(len(texts)), [got[i] for i in range(len(texts))]) == partition(range(len(texts)), classes_of(texts))


def test_components_grow_by_later_links(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(25)]
    later = [(draw.randrange(90), draw.randrange(90)) for _ in range(30)]
    frame = lambda e: spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in e if a != b], "a binary, b binary")
    grown = comps.extended(comps.components(frame(edges)), frame(later))
    whole = comps.components(frame(edges + later))
    assert sorted((bytes(r.node), bytes(r.component)) for r in grown.collect()) == sorted((bytes(r.node), bytes(r.component)) for r in whole.collect())


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Every stage again in plain Python (the line model's scores as they are), on the whole run's rows."""
    import corpus_pipeline as pipeline
    from test_media_and_pairs import base, classes_of, plain_targets
    from test_models import junk

    draw = random.Random(37)
    bench = [(1, prose(draw, 30)), (2, prose(draw, 14)), (3, "tiny item here")]
    rows = []
    for i in range(150):
        lines = [prose(draw, draw.randint(10, 30)) for _ in range(3)]
        if i % 5 == 0:
            lines = [junk(draw) for _ in range(4)]
        if i % 7 == 3:
            lines[1] += f" mail{i}@mail.example.com and +1 (383) 555-{1000 + i}"
        if i % 11 == 4:
            lines[2] = edited(draw, bench[0][1].rstrip("."), 2)
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", 1))
    rows += [(200 + i, rows[4 * i + 1][1], "en", "src1", 1) for i in range(9)] + [(300 + i, edited(draw, rows[4 * i + 1][1], 1), "en", "src2", 1) for i in range(9)]
    rows += [(400, None, None, None, None), rows[2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    score = {r.doc_id: r.score for r in crf.quality_scores(docs, labels, ["doc_id"]).collect()}
    left = [r for r in rows if score[r[0]] >= crf.THRESHOLD]
    assert 100 < len(left) < len(rows)
    classes = classes_of([r[1] for r in left])
    least = {}
    for r, c in zip(left, classes):
        least[c] = min(least.get(c, r[0]), r[0])
    left = sorted({r[0]: r for r, c in zip(left, classes) if least[c] == r[0]}.values())
    leaky = {d for d, _ in leaks_by_brute_force([(r[0], r[1]) for r in left], bench)}
    assert leaky
    left = [r for r in left if r[0] not in leaky]

    def redacted(text):
        if text is None:
            return None
        out, at = "", 0
        for s, k, e in base(text):
            out, at = out + text[at:s] + f"[{pii.KINDS[k].upper()}]", e
        return out + text[at:]

    left = [(r[0], redacted(r[1]), *r[2:]) for r in left]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in left}
    sizes = Counter()
    for r in left:
        sizes[r[3]] += size[r[0]]
    targets = plain_targets(sizes)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in got} <= {(r[0], r[1]) for r in left} and len({r.doc_id for r in got}) == len(got)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and 0 < r.taken <= 2 * r.size and r.copies == r.taken // r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
