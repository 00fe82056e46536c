"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from patterns. Three labelers vote on each: a regex labeler (do the kind's checks
hold?), a gazetteer labeler (known domains, issuers, country codes, key prefixes) and a context labeler
(words just before the span). Expectation-maximisation over the counts of vote patterns, per kind, estimates
each labeler's reliability without labels; the posteriors are soft labels that train a naive Bayes span
classifier on the shape of the spans. The counts are sums over all documents, of bounded size (kinds x vote
patterns x shape values), so a row of them, never a span, reaches the driver. Spans that pass the kind's own
checks are always kept; the classifier adds candidates that fail them.

Defined results: a null text is an empty text and has no spans; positions are code points, ends exclusive;
spans of one kind never overlap, spans of two kinds may; repeated rows are judged each; an empty table gives
an empty result. Texts are never shortened. Patterns use possessive runs anchored at run starts, so the time
is linear in the text and long runs of digits don't recurse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import write_table

KINDS = ("email", "ip", "card", "phone", "secret")
#: A local part may start where the previous match ended, or where no character of a local part precedes.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{8,}+\"?|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
#: Separators that don't stand between two digits are taken out first; what is left is a plain run.
LOOSE = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
CARD = r"[0-9][0-9\x20-]*+"
CARD_THERE = r"(?:[0-9][\x20-]?){12}[0-9]"

#: Gazetteers, and words that speak for or against a kind when they stand just before a span.
TOP_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
COUNTRY = r"\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUER = r"(4|5[1-5]|2[2-7]|3[47]|6011|65)"
RESERVED_IP = r"(0|10|127|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168|22[4-9]|2[3-5][0-9])\."
CONTEXT = {
    "email": "mail|contact|write|correo|courriel|kontakt",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|credit|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|llama",
    "secret": "password|passwd|pwd|token|secret|key",
}
AGAINST = "version|chapter|section|isbn|order|page|build"


def _running(sizes: Column) -> Column:
    """Sums of what stands before each element; in blocks, so that long arrays stay cheap."""
    block = 256
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def each(p: Column) -> Column:
        at = lambda i: F.floor(i / block).cast("int")
        return F.transform(p.sizes, lambda _, i: add(F.slice(p.sums, 1, at(i))) + add(F.slice(p.sizes, at(i) * block + 1, i % block)))

    sums = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: add(F.slice(x, b * block + 1, block)))
    return let(sizes, lambda x: let(F.struct(x.alias("sizes"), sums(x).alias("sums")), each))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of a string of digits."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.when(F.length(plain(p)) <= 3, plain(p).cast("int")).otherwise(999) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(False)


def _votes(kind: str, m: Column, before: Column, valid: Column) -> Column:
    """Three characters, of +, - and 0: regex, gazetteer, context."""
    sign = lambda yes, no=None: F.when(yes, "+").otherwise(F.lit("0") if no is None else F.when(no, "-").otherwise("0"))
    d = _digits(m)
    known = {
        "email": lambda: sign(m.rlike(rf"\.({TOP_DOMAINS})$"), F.lit(True)),
        "ip": lambda: sign(~m.rlike(f"^{RESERVED_IP}"), F.lit(True)),
        "card": lambda: sign(d.rlike(f"^{ISSUER}"), F.lit(True)),
        "phone": lambda: sign(m.rlike(f"^{COUNTRY}"), F.lit(True)),
        "secret": lambda: sign(m.rlike("AKIA|ghp_|sk-|[=:].*(?=.*[0-9])(?=.*[a-f]).{16,}")),
    }[kind]()
    regex = sign(valid, ~valid) if kind != "secret" else sign(m.rlike("[=:]"))
    near = F.lower(F.right(before, F.lit(40)))
    context = sign(near.rlike(rf"\b({CONTEXT[kind]})"), near.rlike(rf"\b({AGAINST})\b"))
    return F.concat(regex, known, context)


def _shape(m: Column, before: Column, after: Column) -> Column:
    """Values of a few bounded features."""
    bucket = lambda n, step, most: F.least(F.floor(n / step), F.lit(most)).cast("string")
    side = lambda c: F.when(c == "", "e").when(c.rlike(r"\s"), "s").when(c.rlike("[0-9]"), "d").when(c.rlike("[A-Za-z]"), "a").otherwise("o")
    return F.array(
        F.concat(F.lit("length:"), bucket(F.length(m), 4, 12)),
        F.concat(F.lit("digits:"), bucket(F.length(_digits(m)), 2, 12)),
        F.concat(F.lit("marks:"), bucket(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), 1, 8)),
        F.concat(F.lit("before:"), side(F.right(before, F.lit(1)))),
        F.concat(F.lit("after:"), side(F.left(after, F.lit(1)))),
    )


def _spans(kind: str, text: Column, pattern: str) -> Column:
    """Array of kind, start, end, base, votes, shape. The text between matches gives their places.

    Arrays that several parts of the expression need are bound by let(), so each is made once a text.
    """

    def spans(p: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(p.starts, i) + F.length(F.get(p.others, i))
            before, after = F.right(F.get(p.others, i), F.lit(40)), F.left(F.get(p.others, i + 1), F.lit(1))
            seen = F.struct(m.alias("m"), start.alias("start"), before.alias("before"), after.alias("after"), _valid(kind, m).alias("valid"))
            return let(
                seen,
                lambda x: F.struct(
                    F.lit(kind).alias("kind"),
                    x.start.alias("start"),
                    (x.start + F.length(x.m)).alias("end"),
                    x.valid.alias("base"),
                    _votes(kind, x.m, x.before, x.valid).alias("votes"),
                    _shape(x.m, x.before, x.after).alias("shape"),
                ),
            )

        return F.transform(p.found, span)

    def placed(p: Column) -> Column:
        lengths = F.transform(p.found, lambda m, i: F.length(m) + F.length(F.get(p.others, i)))
        return F.struct(p.found.alias("found"), p.others.alias("others"), _running(lengths).alias("starts"))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("others"))
    return let(both, lambda p: let(placed(p), spans))


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,shape:array<string>>>"


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column spans_: every candidate span of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr(f"cast(array() as {SPAN})")
    df = docs.withColumn("text_", text)
    t = F.col("text_")
    # Most texts have none of a kind; a look for the characters that it needs, then for the pattern, decides.
    df = df.withColumn("digit_", t.rlike("[0-9]"))
    there = {
        "email": t.contains("@"),
        "ip": F.when(F.col("digit_"), t.rlike(IP)).otherwise(False),
        "card": F.when(F.col("digit_"), t.rlike(CARD_THERE)).otherwise(False),
        "phone": F.when(F.col("digit_") & t.contains("+"), t.rlike(PHONE)).otherwise(False),
        "secret": F.when(t.contains("=") | t.contains(":") | t.contains("AKIA"), t.rlike(SECRET)).otherwise(False),
    }
    df = df.withColumns({f"there_{k}": c for k, c in there.items()})
    df = df.withColumn("loose_", F.when(F.col("there_card"), F.regexp_replace(t, LOOSE, "_")))
    made = {
        "email": _spans("email", t, EMAIL),
        "ip": _spans("ip", t, IP),
        # Runs of fewer than 13 digits are no candidates for a card.
        "card": F.filter(_spans("card", F.col("loose_"), CARD), lambda s: s.end - s.start >= 13),
        "phone": _spans("phone", t, PHONE),
        "secret": _spans("secret", t, SECRET),
    }
    each = [F.when(F.col(f"there_{k}"), made[k]).otherwise(none) for k in KINDS]
    df = df.withColumn("spans_", F.concat(*each).cast(SPAN))
    return df.drop("text_", "loose_", "digit_", *[f"there_{k}" for k in KINDS])


def fit_labelers(counts: dict[str, dict[str, float]], rounds: int = 50) -> dict[str, dict[str, float]]:
    """EM over counts by kind and vote pattern: the probability of each pattern that its spans are real."""
    out: dict[str, dict[str, float]] = {}
    for kind, patterns in counts.items():
        post = {v: min(0.95, max(0.05, 0.5 + 0.2 * (v.count("+") - v.count("-")))) for v in patterns}
        for _ in range(rounds):
            total = {y: 1.0 + sum(n * (p if y else 1 - p) for (n, p) in ((patterns[v], post[v]) for v in patterns)) for y in (0, 1)}
            like = {}
            for y in (0, 1):
                for j in range(3):
                    for s in "+-0":
                        seen = sum(n * (post[v] if y else 1 - post[v]) for v, n in patterns.items() if v[j] == s)
                        # The prior keeps "+" the likelier vote on real spans, so that the classes can't change places.
                        prior = 2.0 if (s == "+") == bool(y) else 1.0
                        like[y, j, s] = (seen + prior) / (total[y] + 5.0)
            for v in patterns:
                a = {y: math.log(total[y]) + sum(math.log(like[y, j, s]) for j, s in enumerate(v)) for y in (0, 1)}
                post[v] = 1 / (1 + math.exp(min(700.0, a[0] - a[1])))
        out[kind] = post
    return out


def train(spans: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds by kind, and by kind and shape value. spans: the column spans_ of all documents."""
    flat = spans.select(F.explode("spans_").alias("s")).select("s.kind", "s.votes", F.explode("s.shape").alias("shape"))
    rows = flat.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded: kinds x 27 x shape values
    counts: dict[str, dict[str, float]] = {}
    for r in rows:
        if r["shape"].startswith("length:"):
            at = counts.setdefault(r["kind"], {})
            at[r["votes"]] = at.get(r["votes"], 0) + r["n"]
    post = fit_labelers(counts)
    return span_classifier(counts, post, {(r["kind"], r["shape"], r["votes"]): r["n"] for r in rows})


def span_classifier(counts: dict[str, dict[str, float]], post: dict[str, dict[str, float]], shapes: dict[tuple[str, str, str], float]) -> tuple[dict[str, float], dict[str, float]]:
    """Naive Bayes on soft labels. counts: by kind and votes. shapes: by kind, shape value and votes.

    The likelihoods of a feature's values sum to 1 in each class: half a span is added to each value, and to the
    class's total as often as the feature has values, so a class without spans speaks neither for nor against any.
    The classes' own sizes get a tenth of a span.
    """
    soft: dict[tuple[str, str], list[float]] = {}
    for (kind, shape, votes), n in sorted(shapes.items()):
        at = soft.setdefault((kind, shape), [0.5, 0.5])
        at[1] += n * post[kind][votes]
        at[0] += n * (1 - post[kind][votes])
    values: dict[tuple[str, str], int] = {}
    for kind, shape in soft:
        feature = (kind, shape.split(":")[0])
        values[feature] = values.get(feature, 0) + 1
    total = {kind: [sum(n * (post[kind][v] if y else 1 - post[kind][v]) for v, n in patterns.items()) for y in (0, 1)] for kind, patterns in counts.items()}
    prior = {kind: math.log((real + 0.1) / (rest + 0.1)) for kind, (rest, real) in total.items()}
    weights = {}
    for (kind, shape), (no, yes) in soft.items():
        rest, real = (x + 0.5 * values[kind, shape.split(":")[0]] for x in total[kind])
        weights[f"{kind} {shape}"] = math.log(yes / real) - math.log(no / rest)
    return prior, weights


def decide(df: DataFrame, model: tuple[dict[str, float], dict[str, float]], least: float = 0.95) -> DataFrame:
    """spans_ keeps the base spans and those that the classifier gives at least ``least``."""
    prior, weights = model
    if not weights:
        return df
    table = lambda m: F.create_map(*[F.lit(x) for kv in sorted(m.items()) for x in kv])
    odds = lambda s: F.aggregate(
        s.shape, F.coalesce(F.element_at(table(prior), s.kind), F.lit(-9.0)), lambda a, x: a + F.coalesce(F.element_at(table(weights), F.concat_ws(" ", s.kind, x)), F.lit(0.0))
    )
    keep = lambda s: s.base | F.when(~s.base, odds(s) >= math.log(least / (1 - least))).otherwise(False)
    return df.withColumn("spans_", F.when(F.size("spans_") > 0, F.filter("spans_", keep)).otherwise(F.col("spans_")))


def _named(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    found, _ = write_table(spark, candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "spans_"), "pii-spans")
    judged = decide(found, train(found))
    base = F.filter("spans_", lambda s: s.base)
    count = lambda k: F.size(F.filter("spans_", lambda s: s.base & (s.kind == k))).cast("long")
    return judged.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans_")).alias("spans"))


def mask(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    own = docs.columns
    found, _ = write_table(spark, candidates(docs, text_col), "pii-docs")
    judged = decide(found, train(found.select("spans_")))
    spans = F.array_sort(F.transform("spans_", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    kind = "array<struct<start:int,end:int,kind:string>>"
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        spans,
        F.expr(f"cast(array() as {kind})"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.get(a, F.size(a) - 1).end > s.start),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a).start.alias("start"), F.greatest(last(a).end, s.end).alias("end"), last(a).kind.alias("kind")))),
        ).otherwise(F.concat(a, F.array(s))),
    )
    text = F.col(text_col)
    judged = judged.withColumn("merged_", F.when(F.size("spans_") > 0, merged))
    part = lambda s, i: F.concat(
        F.substring(text, F.when(i == 0, 1).otherwise(F.get("merged_", i - 1).end + 1), s.start - F.when(i == 0, 0).otherwise(F.get("merged_", i - 1).end)), F.lit("["), F.upper(s.kind), F.lit("]")
    )
    masked = F.concat(F.array_join(F.transform("merged_", part), ""), F.substring(text, last(F.col("merged_")).end + 1, F.length(text)))
    return judged.withColumn(text_col, F.when(F.size("spans_") > 0, masked).otherwise(text)).select(*own)
