"""Personal data in texts: generators, boosted trees and calibrated thresholds.

Base spans are matches of fixed patterns that pass fixed checks (address parts, Luhn sum, number of digits). Wider
generators, one per kind, propose overlapping candidates: any dotted or bracketed address, any run of numbers
with separators. A candidate that holds a base span is a positive example, any other a negative one. Boosted trees
learn to tell them apart by format and context alone: how many digits in how many groups, which separators, what
stands before and after, and which words come before, but not by what the checks look at. Per kind the lowest
score is found above which at least `PRECISION` of the candidates of the other half of the documents are positive, and
candidates above it that overlap no base span are added. All counts are over all documents; what comes to the
driver is one row per cell of features, of which there are at most `math.prod(SIZES)`.

Everything runs as DataFrame functions. Patterns are written so that no text takes more than time
in proportion to its length: runs are entered at their start only, and repeats do not backtrack.
"""

import numpy as np
from pyspark.sql import functions as F

from gridprep.functions.text import let
from gridprep.llm import boosting

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.95
LEAST_SUPPORT = 50
BLOCK = 256

# the same matches as the plain patterns, entered at the start of a run
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+",
    "card": r"[0-9](?:[\x20.-]?[0-9])++",
    "phone": r"[+(]?[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_PART_UP_TO_255 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

# digits, groups, separators, before, after, words before: how many values each feature has
FEATURES = ["digits", "groups", "separators", "before", "after", "context"]
SIZES = [10, 6, 6, 5, 5, 5]
_DIGIT_STEPS = [1, 4, 7, 10, 11, 12, 14, 16, 17]
_CONTEXT = [
    r"(?i)(?:phone|tel|call|mobile|fax|whatsapp)[^A-Za-z]*$",
    r"(?i)(?:e-?mail|mail|contact|write to)[^A-Za-z]*$",
    r"(?i)(?:ip|server|host|address|login)[^A-Za-z]*$",
    r"(?i)(?:card|visa|credit|account|iban|payment)[^A-Za-z]*$",
]


def _digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits):
    """Whether the Luhn sum of a short string of digits is a multiple of 10."""
    turned = F.reverse(digits)

    def step(total, i):
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def is_valid(kind, match):
    """Whether a match of the kind's base pattern passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(_PART_UP_TO_255)
    if kind == "card":
        return let(F.translate(match, " -", ""), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(match)).between(10, 15)


def _totals(values):
    """Running totals of an array of longs."""
    return _running(values, lambda a, b: a + b)


def _running(values, combine):
    """Running sums, or whatever `combine` makes with zero as its neutral start, of an array of longs, in blocks, so that
    the work grows little faster than the array."""
    def total(part):
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, b: combine(a, b))

    def inside(block):
        return F.transform(block, lambda _, i: total(F.slice(block, F.lit(1), i + 1)))

    def joined(blocks):
        sums = F.transform(blocks, lambda b: F.element_at(b, -1))
        return let(sums, lambda s: F.flatten(F.transform(blocks, lambda block, j: let(
            total(F.slice(s, F.lit(1), j)), lambda before: F.transform(block, lambda x: combine(x, before)),
        ))))

    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda i: inside(F.slice(values, i, F.lit(BLOCK))))
    return F.when(F.size(values) > 0, let(blocks, joined)).otherwise(F.array().cast("array<bigint>"))


SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def matches(text, pattern, hint):
    """All matches of a pattern with their places in code points; texts that fail the cheap `hint` have none.

    The pieces between the matches come from splitting the text by the same pattern.
    """
    def placed(found):
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
        ends = let(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m)), _totals)
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    none = F.array().cast(SPAN)
    found = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m).cast(SPAN)).otherwise(none))


def _hint(kind, text, wide=False):
    if kind == "email":
        at = F.contains(text, F.lit("@"))
        return at | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) if wide else at
    if kind == "phone" and not wide:
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][-\\x20().]?[0-9]")


def base_spans(text, kind):
    return F.filter(matches(text, BASE[kind], _hint(kind, text)), lambda s: is_valid(kind, s["match"]))


def _steps(value, limits):
    return sum(((value >= limit).cast("int") for limit in limits), F.lit(0))


def _sign(c):
    """What kind of sign stands next to a candidate: none, white space, letter, digit, other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _features(text, s):
    match = s["match"]
    kept = F.regexp_replace(match, r"^[+(]+", "")
    digits = F.length(_digits(match))
    groups = F.size(F.split(kept, r"[^0-9A-Za-z]+"))
    marks = F.regexp_replace(kept, r"[0-9A-Za-z_%+]+", "")
    separators = (
        F.when(marks == "", 0).when(marks.rlike(r"^\x20+$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike(r"^\.+$"), 3)
        .when(F.contains(marks, F.lit("@")), 4).otherwise(5)
    )
    start = s["start"].cast("int")
    left = F.substr(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
    before = F.when(start == 0, F.lit("")).otherwise(F.substr(text, start, F.lit(1)))
    after = F.substr(text, s["end"].cast("int") + 1, F.lit(1))
    context = F.when(left.rlike(_CONTEXT[0]), 1).when(left.rlike(_CONTEXT[1]), 2).when(left.rlike(_CONTEXT[2]), 3).when(left.rlike(_CONTEXT[3]), 4).otherwise(0)
    columns = [_steps(digits, _DIGIT_STEPS), F.least(groups, F.lit(6)) - 1, separators, _sign(before), _sign(after), context]
    return [c.cast("int").alias(name) for c, name in zip(columns, FEATURES)]


def _worth(kind, match):
    """Which matches of a wide pattern are proposed at all."""
    if kind == "card":
        return F.length(_digits(match)).between(13, 19)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _holds_base(kind, match):
    return F.exists(F.regexp_extract_all(match, F.lit(BASE[kind]), F.lit(0)), lambda m: is_valid(kind, m))


def candidates(text, kind):
    """Proposed spans with their features and whether they hold a base span."""
    found = F.filter(matches(text, WIDE[kind], _hint(kind, text, True)), lambda s: _worth(kind, s["match"]))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _holds_base(kind, s["match"]).alias("sure"), *_features(text, s)))


def _numbered(found, kind):
    return F.transform(found, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c")))


def _count(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def train(docs):
    """For each kind (trees, threshold) from all documents; a kind without enough examples adds nothing (threshold None)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(2)), F.lit(0)).cast("int").alias("half")
    rows = docs.select(text.alias("text")).select("text", half)
    every = rows.select("half", F.explode(F.concat(*[_numbered(candidates(F.col("text"), kind), i) for i, kind in enumerate(KINDS)])).alias("x"))
    keys = [F.col(f"x.c.{name}").alias(name) for name in FEATURES]
    cells = (
        every.select("half", F.col("x.kind").alias("kind"), F.col("x.c.sure").cast("int").alias("sure"), *keys)
        .groupBy("kind", "half", *FEATURES).agg(F.sum("sure").alias("positive"), F.count("*").alias("total"))
    )
    table = np.array(sorted(tuple(r) for r in cells.collect()), np.int64).reshape(-1, 4 + len(FEATURES))
    return {kind: _calibrated(table[table[:, 0] == i]) for i, kind in enumerate(KINDS)}


def _calibrated(cells):
    """(trees, threshold): fitted on one half of the documents, calibrated on the other."""
    half, x, positive, total = cells[:, 1], cells[:, 2:-2], cells[:, -2], cells[:, -1]
    learn, judge = half == 0, half == 1
    if not positive[learn].sum():
        return None, None
    model = boosting.fit(x[learn], positive[learn].astype(float), total[learn].astype(float))
    score = boosting.predict(model, x[judge])
    threshold = None
    for limit in sorted(set(score.tolist()), reverse=True):
        above = score >= limit
        if total[judge][above].sum() >= LEAST_SUPPORT and positive[judge][above].sum() >= PRECISION * total[judge][above].sum():
            threshold = limit
    return model, threshold


def _added(text, kind, model, base):
    """Candidates above the threshold that hold and overlap no base span."""
    trees, threshold = model
    if threshold is None:
        return F.array().cast("array<struct<start:bigint,end:bigint>>")
    sure = F.filter(candidates(text, kind), lambda c: ~c["sure"] & (boosting.score_column(trees, [c[f] for f in FEATURES]) >= F.lit(threshold - 1e-9)))
    return _apart_from(sure, base)


def _apart_from(spans, base):
    """The spans, as (start, end), that overlap no base span.

    Base spans by their start and spans by their end are sorted together; a span is free if no base span before it, in
    this order, ends behind its start.
    """
    zero = F.lit(0).cast("bigint")
    marks = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("turn"), zero.alias("start"), s["end"].alias("reach"))),
        F.transform(spans, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("turn"), c["start"].alias("start"), zero.alias("reach"))),
    )

    def free(sorted_marks):
        reach = _running(F.transform(sorted_marks, lambda m: m["reach"]), F.greatest)
        return let(reach, lambda r: F.transform(
            F.filter(sorted_marks, lambda m, i: (m["turn"] == 0) & (F.get(r, i) <= m["start"])),
            lambda m: F.struct(m["start"].alias("start"), m["at"].alias("end")),
        ))

    return let(F.array_sort(marks), free)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs, models):
    """`docs` with the columns text (empty for null), base and spans: arrays of (start, kind, end), by start and then kind.

    Places are code points, `end` is exclusive, `kind` counts in KINDS. Base spans of one kind do not
    overlap, those of different kinds may. Added spans overlap no base span. Repeated rows each get a row; columns
    of `docs` other than those names are kept.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.drop("base", "spans").withColumn("text", text)

    def as_kind(spans, i):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    base = F.array_sort(F.concat(*[as_kind(base_spans(F.col("text"), kind), i) for i, kind in enumerate(KINDS)]))
    rows = rows.withColumn("base", base)
    added = [as_kind(_added(F.col("text"), kind, models[kind], F.col("base")), i) for i, kind in enumerate(KINDS)]
    return rows.withColumn("spans", F.array_sort(F.concat("base", *added)))


def report(found):
    """One row per document: doc_id, the number of base spans of each kind, the hash of their list, all spans."""
    counts = [_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(found):
    """The text with each stretch that spans cover replaced by the name of its first kind in brackets.

    Spans that overlap are one stretch. Returns `found` with the new text and without base and spans.
    """
    def stretches(spans):
        """The first span of each stretch, with the end of the stretch: the furthest end before the next one starts."""
        def cut(reach):
            heads = F.filter(
                F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i"))),
                lambda s: (s["i"] == 0) | (F.get(reach, s["i"] - 1) <= s["start"]),
            )
            return let(heads, lambda h: F.transform(h, lambda s, j: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"),
                F.get(reach, F.coalesce(F.get(h, j + 1)["i"], F.size(spans)) - 1).alias("end"),
            )))

        return let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), cut)

    def rewritten(parts):
        names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])

        def piece(s, i):
            after = F.when(i == 0, F.lit(0)).otherwise(F.get(parts, i - 1)["end"]).cast("int")
            return F.concat(F.substr(F.col("text"), after + 1, s["start"].cast("int") - after), F.element_at(names, s["kind"] + 1))

        rest = F.substr(F.col("text"), F.element_at(parts, -1)["end"].cast("int") + 1, F.length("text"))
        return F.concat(F.array_join(F.transform(parts, piece), ""), rest)

    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(let(let(F.col("spans"), stretches), rewritten))
    return found.withColumn("text", text).drop("base", "spans")
