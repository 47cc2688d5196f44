"""Personal data: wide candidate generators, and gradient-boosted trees that
select among them; in DataFrame operations only.

Base spans are those of four patterns (email, ip, card, phone) that pass their
check; they always stay. Where a base match fails its check, it may still hold
personal data (a phone number with a card number behind it is one match of 27
digits). Generators propose such spans, which may overlap each other. Only
proposals that pass their kind's check and don't overlap a base span can be
added, the likeliest of overlapping ones first.

Boosted trees, written as one column expression, see the format and the
context of a candidate, but not the check: they learn how often candidates
like it pass. Labels are the checks of whole base matches (passed: 1, failed:
0). Candidates inside a match have no label, as they may be parts of a number; nor
have those that no base match touches. They are scored as others of their format. A logistic curve on the
third of the sample that the trees don't see calibrates them. A number that
is no card passes its check by chance (``CHANCE``), so the share p that passes
holds (p - chance) / (1 - chance) true ones; a candidate is added where at
least ``LEAST`` of those that pass are true, and p is at least one half for
kinds whose check isn't passed by chance.

Learning searches about ``DOCUMENTS`` texts, drawn by a hash of the text, equal
texts once, and uses at most ``SAMPLE`` candidates of them, the first by a hash
of text and place.

Everything else happens inside a row, in one pass and without a shuffle;
positions come from the lengths of matches and of the pieces between them.
Patterns are possessive, so that long runs neither backtrack nor recurse.

Defined results: null and empty texts have no spans; repeated rows get equal
results; without candidates of both labels no span is added; of equally likely
overlapping candidates the first one is added; overlong numbers fail their
checks; an empty table gives no rows; long texts are searched whole; columns
named ``base_spans`` or ``spans`` are replaced by these where spans are returned,
and all columns pass through a redaction unchanged but for ``text``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sieve import numbered
from .storage import documents, written

KINDS = ("email", "ip", "card", "phone")
DOCUMENTS, SAMPLE = 20_000, 20_000
ROUNDS, DEPTH, RATE = 30, 3, 0.3
SHRINK, LEAF = 1.0, 2.0  # of leaf values, and a leaf's least weight (candidates times the variance of their label)
LEAST = 0.8  # share of true spans among added ones
CHANCE = {"card": 0.1}  # of passing the check: one of ten check digits
CONTEXT = 24

#: Base matches. A start inside a run that the pattern has refused can't match
#: either, so runs are entered at their begin (or right after a match).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates, by kind.
WIDE = {
    "email": (r"[A-Za-z0-9._%+-]{1,64}+\s?[\[(]at[\])]\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z0-9-]{1,63}+){1,4}+",),
    "ip": (r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9])",),
    "card": (r"(?<![0-9])[0-9]{12,19}+(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])", r"(?<![0-9])3[0-9]{3}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])"),
    "phone": (
        r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
        r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        r"(?<![0-9+])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    ),
}
CUES = {
    "cue_email": r"(?i)\b(e-?mail|mailto|contact)",
    "cue_phone": r"(?i)\b(phone|tel|call|fax|mobil|cell)",
    "cue_card": r"(?i)\b(card|visa|credit|master|amex|payment)",
    "cue_ip": r"(?i)\b(ip|addr|host|server)",
    "cue_number": r"(?i)\b(order|ref|no|nr|id|serial|version|isbn|invoice|ticket)\b",
}
FORMAT = ("kind", "n_chars", "n_digits", "n_groups", "plus", "parens", "distinct", "longest")
NAMES = (*FORMAT, "before", "after", "digits_near", *CUES)


def matches(text: Column, pattern: str) -> Column:
    """All matches as (s, e, v), in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("p"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits pass the check sum."""
    number = F.reverse(digits(value))
    each = F.transform(F.split(number, ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 1, F.element_at(F.array(*[F.lit(int(x)) for x in "0246813579"]), c.cast("int") + 1)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.length(number).between(12, 19) & F.when(F.length(number).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return luhn(value)
    return F.length(digits(value)).between(9, 15)


def base_matches(text: Column) -> Column:
    """(s, kind number, e, ok) of all base matches, by start."""


    def checked(number: int, kind: str) -> Column:
        return F.transform(matches(text, BASE[kind]), lambda m: F.struct(m["s"].alias("s"), F.lit(number).alias("k"), m["e"].alias("e"), passes(kind, m["v"]).alias("ok")))

    return F.array_sort(F.concat(*[checked(number, kind) for number, kind in enumerate(KINDS)]))


def candidates(text: Column) -> Column:
    """(s, kind number, e, ok, f: features) of what the generators propose."""

    def character(s: Column) -> Column:
        c = F.substring(text, s, F.lit(1))
        return F.when((s < 1) | (c == ""), 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 3).otherwise(2)

    def proposed(number: int, kind: str, pattern: str) -> Column:
        def featured(m: Column) -> Column:
            v, only = m["v"], digits(m["v"])
            left = F.substring(text, F.greatest(m["s"] - CONTEXT + 1, F.lit(1)), F.least(m["s"], F.lit(CONTEXT)))
            values = (
                F.lit(number), F.length(v), F.length(only), F.size(F.split(v, "[^0-9A-Za-z]+")), v.contains("+").cast("int"), v.contains("(").cast("int"),
                F.size(F.array_distinct(F.split(only, ""))), F.array_max(F.transform(F.split(v, "[^0-9]+"), lambda x: F.length(x))),
                character(m["s"]), character(m["e"] + 1), F.length(digits(left)), *(left.rlike(cue).cast("int") for cue in CUES.values()),
            )
            return F.struct(
                m["s"].alias("s"), F.lit(number).alias("k"), m["e"].alias("e"), passes(kind, v).alias("ok"),
                F.struct(*[x.cast("double").alias(name) for x, name in zip(values, NAMES, strict=True)]).alias("f"),
            )

        return F.transform(matches(text, pattern), featured)

    return F.array_distinct(F.concat(*[proposed(n, k, p) for n, k in enumerate(KINDS) for p in WIDE[k]]))


Tree = tuple  # (feature, cut, low, high) or (value,)


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> Tree:
    """A regression tree for one Newton step. Leaves need some weight, as noise
    in a few candidates isn't worth a branch."""
    leaf = (float(RATE * gradient.sum() / (hessian.sum() + SHRINK)),)
    if depth == 0:
        return leaf
    score = gradient.sum() ** 2 / (hessian.sum() + SHRINK)
    best = (1.0, -1, 0.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1][:64]:
            low = x[:, f] <= cut
            weights = hessian[low].sum(), hessian[~low].sum()
            if min(weights) < LEAF:
                continue
            gain = gradient[low].sum() ** 2 / (weights[0] + SHRINK) + gradient[~low].sum() ** 2 / (weights[1] + SHRINK) - score
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], gradient[low], hessian[low], depth - 1), grow(x[~low], gradient[~low], hessian[~low], depth - 1)


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], walk(tree[2], x), walk(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    first = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin, trees = np.full(len(y), first), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(x, y - p, p * (1 - p), DEPTH))
        margin += walk(trees[-1], x)
    return first, trees


def as_column(tree: Tree, f: Column) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    return F.when(f[NAMES[tree[0]]] <= tree[1], as_column(tree[2], f)).otherwise(as_column(tree[3], f))


def searched(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``base`` and ``wide``; only texts that hold a digit, an at sign or its word are searched."""
    text = F.coalesce(text, F.lit(""))
    some = text.rlike(r"[0-9@]|[\[(]at[\])]")
    rows = df.withColumn("searched", F.when(some, text).otherwise(F.lit("")))
    return rows.withColumn("base", base_matches(F.col("searched"))).withColumn("wide", candidates(F.col("searched"))).drop("searched")


def labelled(docs: DataFrame, texts: int = DOCUMENTS) -> DataFrame:
    """Candidates of about ``texts`` texts with their labels ``y`` and a hash ``h``."""
    n, whole = docs.count(), 1 << 30
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    picked = docs.select(F.col("text"), key.alias("key"))
    if n > texts:
        picked = picked.where(F.pmod("key", F.lit(whole)) < int(whole * texts / n))
    picked = written(picked, "pii-sample")  # else the patterns run over all texts before the draw
    rows = searched(picked, F.col("text")).where(F.size("wide") > 0).select("key", "base", F.explode("wide").alias("c"))
    same = "b.k = c.k and b.s = c.s and b.e = c.e"
    label = F.expr(f"case when exists(base, b -> b.ok and {same}) then 1 when exists(base, b -> {same}) then 0 end")
    rows = rows.select("key", "c.s", "c.e", "c.k", "c.f", label.alias("y")).where("y is not null")
    return rows.withColumn("h", F.xxhash64("key", "s", "e", "k")).dropDuplicates(["h"])


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve (a, b) of margins by Newton's method, held near (0, 1)."""
    a, b = 0.0, 1.0
    design = np.stack([np.ones_like(margin), margin], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * margin, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        da, db = np.linalg.solve(hess, design.T @ (y - p) - np.array([a, b - 1]))
        a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
    return a, b


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Trees, and for each kind the margin from where candidates are added."""
    found = labelled(docs).orderBy("h").limit(sample).select("f.*", "y", "h").collect()
    x, y = np.array([r[: len(NAMES)] for r in found]), np.array([r.y for r in found], float)
    seen = np.array([r.h % 3 != 0 for r in found], bool)
    if len(set(y[seen].tolist())) < 2:
        return None
    first, trees = boost(x[seen], y[seen])
    a, b = calibrated(first + sum(walk(t, x[~seen]) for t in trees), y[~seen])
    if b <= 0:
        return None
    least = [c / (1 - LEAST * (1 - c)) if (c := CHANCE.get(kind, 0.0)) else 0.5 for kind in KINDS]
    return {"first": first, "trees": trees, "cuts": [float((np.log(p / (1 - p)) - a) / b) for p in least]}


def found_spans(df: DataFrame, text: Column, model: dict | None) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans``; none of its columns may be named like a step's."""
    rows = searched(df, text)
    base = F.transform(F.filter("base", lambda b: b["ok"]), lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    rows = rows.withColumn("base_spans", base)
    if model is None:
        return rows.withColumn("spans", F.col("base_spans")).drop("base", "wide")

    def scored(c: Column) -> Column:
        margin = F.lit(model["first"])
        for tree in model["trees"]:
            margin = margin + as_column(tree, c["f"])
        return F.struct((-margin).alias("m"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))

    free = F.expr("filter(wide, c -> c.ok and not exists(base_spans, b -> b.s < c.e and b.e > c.s))")
    cuts = F.array(*[F.lit(-x) for x in model["cuts"]])
    likely = F.filter(F.transform(free, scored), lambda c: c["m"] <= F.element_at(cuts, c["k"] + 1))
    rows = rows.withColumn("likely", F.array_sort(likely))
    taken = """aggregate(likely, cast(array() as array<struct<s:int,k:int,e:int>>),
        (a, c) -> if(exists(a, b -> b.s < c.e and b.e > c.s), a, concat(a, array(named_struct('s', c.s, 'k', c.k, 'e', c.e)))))"""
    rows = rows.withColumn("spans", F.array_sort(F.concat("base_spans", F.expr(taken))))
    return rows.drop("base", "wide", "likely")


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (s, k, e), the
    latter with the added ones, both by start and kind."""
    names = docs.columns
    found = found_spans(numbered(docs), F.col(f"c{names.index('text')}"), learn(docs))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in ("base_spans", "spans")), "base_spans", "spans")


def joined(column: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', element_at(array({kinds}), x.k + 1), x.s, x.e)), ',')")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets."""
    names = docs.columns
    text = f"c{names.index('text')}"
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    rebuilt = f"""aggregate(spans, named_struct('at', 0, 'out', ''),
        (a, x) -> if(x.s >= a.at,
            named_struct('at', x.e, 'out', concat(a.out, substring({text}, a.at + 1, x.s - a.at), element_at(array({kinds}), x.k + 1))),
            named_struct('at', greatest(a.at, x.e), 'out', a.out)),
        a -> concat(a.out, substring({text}, a.at + 1)))"""
    found = found_spans(numbered(docs), F.col(text), learn(docs))
    found = found.withColumn(text, F.when(F.size("spans") > 0, F.expr(rebuilt)).otherwise(F.col(text)))
    return found.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.k = {n})) as long)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    digest = F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
