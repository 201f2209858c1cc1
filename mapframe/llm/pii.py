"""Personal data by candidate gradient boosting, in DataFrame functions alone.

High-recall generators propose spans, which may overlap; features of the format of a span and of the words around it go
through gradient-boosted trees; a threshold for each kind, calibrated on examples held back from the trees, selects
what is added to the spans that the base rules establish. Base spans always stay.

Everything about a text happens in its row: positions come from the gaps between the matches of a pattern, so there is
no shuffle, and the trees are one expression of the features. The trees are fitted on :func:`examples`, a labelled set
of fixed size that is made by rules (there are no labels of personal data in the corpus), once a process.

Defined results: a null text counts as empty; the text of an empty or clean row gives no spans and the digest of the
empty string; repeated rows get a row each; an empty table gives no row; other columns pass through, but for columns
named ``base`` or ``spans``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm.common import spare

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive groups and the look-behinds change no match: what follows a group can't use what it took,
# and a match that could start within a run of its first class also starts at the run's beginning. They keep the search
# linear and its stack flat on very long texts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?@\x20?|\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
#: The generators of further candidates, as (kind, pattern).
GENERATORS = (
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+"),
    ("ip", r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[\[(]\.[\])]\x20?[0-9]{1,3}+){3}+(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{3,6}+(?:\x20?[\x20._/-]\x20?[0-9]{2,6}+){1,5}+(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])[(+]?[0-9]{1,5}+[)]?(?:[\x20./-]{1,2}\(?[0-9]{1,6}+\)?){1,6}+(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])[+]?[0-9]{7,15}+(?![0-9A-Za-z])"),
)
#: Characters on either side of a span that count as its context.
CONTEXT = 32
TREES, DEPTH = 16, 4
#: Share of the selected examples that must be right, for the calibrated thresholds.
PRECISION = 0.995
EXAMPLES = 6000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, op: Callable[[Column, Column], Column], step: int = 512) -> Column:
    """Running results of an associative ``op`` over an array of longs with an element. First within pieces of ``step``,
    then over the pieces: no long array is copied once for each of its elements."""

    def within(many: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(many, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.try_element_at(acc, F.lit(-1)), x)))))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int")), lambda k: within(F.slice(values, k * step + 1, step)))
    moved = lambda x, k, ends: F.when(k == 0, x).otherwise(F.transform(x, lambda y: op(F.try_element_at(ends, k), y)))
    joined = lambda p: let(within(F.transform(p, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(p, lambda x, k: moved(x, k, ends))))
    return let(pieces, lambda p: F.when(F.size(p) == 1, F.element_at(p, 1)).otherwise(joined(p)))


_FOUND = "array<struct<start:bigint,end:bigint,span:string,before:string,after:string>>"


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and without overlap: start and end in code points, span, context."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(gap: Column, hit: Column) -> Column:
        sizes = F.zip_with(F.slice(gap, 1, F.size(hit)), hit, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        one = lambda end, i: let(F.element_at(hit, i + 1), lambda h: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("span"), F.right(F.element_at(gap, i + 1), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(gap, i + 2), F.lit(CONTEXT)).alias("after")))
        return F.transform(_scan(sizes, lambda a, b: a + b), one)

    none = F.array().cast(_FOUND)
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), let(gaps, lambda g: let(hits, lambda h: located(g, h)))).otherwise(none)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)
    doubled = lambda x, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)  # noqa: E731  i counts from 0
    figures = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(figures, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _octets(span: Column) -> Column:
    short = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(F.regexp_replace(span, r"[^0-9.]", ""), r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))


def valid(kind: str, span: Column) -> Column:
    """The test that a match of a base pattern must pass."""
    if kind == "ip":
        return _octets(span)
    if kind == "card":
        return let(_digits(span), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(span)).between(10, 15)
    return F.lit(True)


# Words that stand before data of a kind, and before numbers that are none; top-level domains.
_WORDS = {
    "phone": "tel|telephone|phone|call|mobile|cell|fax|sms|whatsapp|ring|dial|telefon|handy|móvil|teléfono|téléphone",
    "card": "card|visa|mastercard|amex|credit|debit|cc|pan|karte|carte|tarjeta",
    "ip": "ip|ipv4|ipv6|host|server|addr|address|ping|client|peer",
    "email": "mail|e-mail|email|contact|write|reach|correo|courriel",
    "other": "isbn|issn|order|invoice|ref|reference|id|no|nr|version|release|build|page|date|serial|tracking|sku|total|year|years|sum|mac|time|section|between|from",
}
_TLD = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|example"
FEATURES = ("kind", "length", "digits", "groups", "plus", "bracket", "dot", "luhn", "octets", "date", "tld", "hexes", "marked", "longest", "w_phone", "w_card", "w_ip", "w_email", "w_other", "left", "right")


def features(kind: Column, span: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers about the format of a candidate and its context, by name."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    digits, longest = _digits(span), F.array_max(F.transform(F.regexp_extract_all(span, F.lit("[0-9]+"), F.lit(0)), F.length))
    near = lambda words: yes(before.rlike(rf"(?i)(?:^|[^\p{{L}}])(?:{words})[^\p{{L}}]{{0,8}}$") | before.rlike(rf"(?i)(?:^|[^\p{{L}}])(?:{words})[^\p{{L}}]+\p{{L}}{{1,8}}[^\p{{L}}]{{0,4}}$"))
    return {
        "kind": kind.cast("double"), "length": F.length(span).cast("double"), "digits": F.length(digits).cast("double"),
        "groups": F.size(F.regexp_extract_all(span, F.lit("[0-9]+"), F.lit(0))).cast("double"), "plus": yes(span.startswith("+")), "bracket": yes(span.rlike(r"\([0-9]+\)")),
        "dot": yes(span.rlike(r"[0-9]\.[0-9]")), "luhn": yes(F.when(F.length(digits).between(13, 19), luhn(digits))), "octets": yes(F.when(F.size(F.split(span, r"\.")) == 4, _octets(span))),
        "date": yes(span.rlike(r"^(?:(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}(?:[-/. ][0-9]{1,2})?|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[-/. ]{1,2}(?:19|20)?[0-9]{2})$")),
        "tld": yes(span.rlike(rf"(?i)(?:{_TLD})$")), "hexes": F.size(F.split(span, "::?")).cast("double"), "marked": yes(span.rlike(r"[@(\[{]")), "longest": F.coalesce(longest, F.lit(0)).cast("double"),
        **{f"w_{k}": near(w) for k, w in _WORDS.items()}, "left": yes(before.rlike(r"[\p{L}0-9_$€£#=/:.-]$")), "right": yes(after.rlike(r"^[\p{L}0-9_%€$/:=-]|^[.,][0-9]")),
    }


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """``n`` labelled candidates (kind, span, before, after, label), made by rule from hashes of their numbers."""
    pick = lambda salt, *of: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    number = lambda salt, size: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**size)).cast("string"), size, "0")
    word = lambda salt: pick(salt, "anna", "info", "the", "ering", "thono", "heble", "jan.k", "erea", "tion", "sales", "ouvi", "keit")
    hexes = lambda salt, size: F.substring(F.sha1(F.concat_ws("-", "id", F.lit(salt)).cast("binary")), 1, size)
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    check = lambda body: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), luhn), 1)
    full = check(F.concat(F.lit("4"), number("c", 14)))
    grouped = lambda sep: F.regexp_replace(full, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    bad = F.concat(F.lit("7"), number("b", 15))
    at, dot = pick("at", " at ", "(at)", "[at]", " (at) ", " @ ", " [at] "), pick("dot", " dot ", "(dot)", "[dot]", ".", ".")
    said = lambda kind: pick("said" + kind, *(f" {w}{e}" for w in _WORDS[kind].split("|")[:8] for e in (" ", ": ", " is ")))
    plain = pick("plain", " of the ", ", ", " that eres ", ". ", " und ", " (", " ")
    rows = [
        (0, text(word(1), at, word(2), dot, pick("tld", *_TLD.split("|")[:8])), pick(9, said("email"), plain), 1),
        (0, text(word(1), " at ", word(2), " dot ", word(3)), plain, 0),
        (0, text(word(1), " at ", word(2), ".", word(3)), plain, 0),
        (1, text(hexes(1, 4), ":", hexes(2, 4), ":", hexes(3, 4), ":", hexes(4, 4), ":", hexes(5, 4), ":", hexes(6, 4), ":", hexes(7, 4), ":", hexes(8, 4)), pick(9, said("ip"), plain), 1),
        (1, text("2001:", hexes(1, 3), "::", hexes(2, 4), ":", hexes(3, 4)), said("ip"), 1),
        (1, text(number(1, 2), "[.]", number(2, 2), "[.]1", number(3, 2), "[.]", number(4, 2)), pick(9, said("ip"), plain), 1),
        (1, text(hexes(1, 2), ":", hexes(2, 2), ":", hexes(3, 2), ":", hexes(4, 2), ":", hexes(5, 2), ":", hexes(6, 2)), pick(9, said("other"), plain), 0),
        (1, text(pick(1, "1", "2"), pick(2, "0", "1", "2"), ":", pick(3, "15", "30", "45"), ":", pick(4, "05", "20", "59")), pick(9, said("other"), plain), 0),
        (2, pick(1, grouped("."), grouped("/"), grouped("_"), grouped(" - ")), pick(9, said("card"), plain), 1),
        (2, check(F.concat(F.lit("4"), number("d", 11))), said("card"), 1),
        (2, pick(1, bad, F.regexp_replace(bad, "([0-9]{4})(?=[0-9])", "$1 "), F.regexp_replace(bad, "([0-9]{4})(?=[0-9])", "$1.")), pick(9, said("other"), plain), 0),
        (2, text("978-", number(1, 1), "-", number(2, 4), "-", number(3, 4), "-", number(4, 1)), pick(9, " ISBN ", plain), 0),
        (2, text("20", number(1, 2), pick(2, "01", "07", "12"), number(3, 2), number(4, 6)), pick(9, said("other"), plain), 0),
        (2, text(number(1, 3), ".", number(2, 3), ".", number(3, 3)), plain, 0),
        (3, pick(1, text("(", number(1, 3), ") ", number(2, 3), "-", number(3, 4)), text(number(1, 3), "-", number(2, 3), "-", number(3, 4)), text("0", number(1, 2), " ", number(2, 4), " ", number(3, 4)), text("+", number(1, 2), " ", number(2, 3), " ", number(3, 3))), said("phone"), 1),
        (3, text("(", number(1, 3), ") ", number(2, 3), "-", number(3, 4)), plain, 1),
        (3, text("+", number(1, 2), " ", number(2, 2), " ", number(3, 2), " ", number(4, 2)), plain, 1),
        (3, pick(1, text("20", number(1, 2), "-0", number(2, 1), "-1", number(3, 1)), text("1", number(2, 1), ".0", number(3, 1), ".19", number(1, 2)), text("19", number(1, 2), "-20", number(2, 2))), pick(9, said("other"), plain), 0),
        (3, pick(1, text(number(1, 1), " ", number(2, 3), " ", number(3, 3)), text(number(1, 3), "-", number(2, 3), "-", number(3, 4)), text(number(1, 8))), pick(9, said("other"), plain), 0),
        (3, text(number(1, 2), " ", number(2, 2), " ", number(3, 2)), plain, 0),
    ]
    made = pick("row", *(F.struct(F.lit(k).alias("kind"), s.alias("span"), b.alias("before"), F.lit(y).cast("double").alias("label")) for k, s, b, y in rows))
    after = pick("after", " ", ", ere ", ".", " and", ") ", ";")
    return spark.range(n).select("id", made.alias("e")).select("id", "e.*", after.alias("after"))


class Trees:
    """Boosted trees as nested tuples ``(feature, threshold, left, right)`` or a number, and a threshold a kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[int, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def margin(self, value: Callable[[str], Column]) -> Column:
        """The sum of the trees as one expression of the features."""

        def branch(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(value(FEATURES[feature]) <= threshold, branch(left)).otherwise(branch(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + branch(tree) * weight
        return total


def _nested(lines: list[str]):
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _nested(lines)
    lines.pop(0)  # Else
    return int(feature), float(threshold), left, _nested(lines)


_fitted: dict[tuple, Trees] = {}


def fitted(spark: SparkSession, trees: int = TREES, depth: int = DEPTH, n: int = EXAMPLES, precision: float = PRECISION) -> Trees:
    """Trees fitted on two thirds of the examples, thresholds calibrated on the rest; made once a process."""
    at = (trees, depth, n, precision)
    if at in _fitted:
        return _fitted[at]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = examples(spark, n)
    own = features(F.col("kind"), F.col("span"), F.col("before"), F.col("after"))
    rows = rows.select("kind", "label", (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(3)) == 0).alias("held"), F.struct(*(own[f].alias(f) for f in FEATURES)).alias("f")).coalesce(2).cache()
    learnt = rows.where("not held").select("label", array_to_vector(F.array(*(F.col(f"f.{f}") for f in FEATURES))).alias("features")).cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, seed=3, cacheNodeIds=False).fit(learnt)
    found_trees = [_nested(t.toDebugString.splitlines()[1:]) for t in model.trees]
    result = Trees(found_trees, [float(w) for w in model.treeWeights], {})
    rated = rows.where("held").select("kind", "label", F.round(result.margin(lambda f: F.col(f"f.{f}")), 2).alias("margin"))
    for kind in range(len(KINDS)):
        right = total = 0
        chosen = 0.0  # a margin below 0 is never selected
        best = None
        steps = rated.where(F.col("kind") == kind).groupBy("margin").agg(F.sum("label").alias("y"), F.count("*").alias("n")).orderBy(F.desc("margin")).collect()
        for r in steps:
            right, total = right + r.y, total + r.n
            if right >= precision * total:
                best = r.margin
        result.thresholds[kind] = max(chosen, best) if best is not None else float("inf")
    learnt.unpersist()
    rows.unpersist()
    _fitted[at] = result
    return result


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_PROPOSED = "array<struct<kind:int,start:bigint,end:bigint,span:string,before:string,after:string>>"


def spans(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of ``(start, kind, end)`` by start and kind, the latter with what the
    trees add. An added span overlaps no base span; added spans are taken by falling margin (then the first), each unless
    it overlaps one that was taken before it."""
    model = model or fitted(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SPAN)

    def established(k: int, kind: str) -> Column:
        right = F.filter(found(text, BASE[kind]), lambda x: valid(kind, x.span))
        return F.transform(right, lambda x: F.struct(x.start.alias("start"), F.lit(k).alias("kind"), x.end.alias("end")))

    base = [established(k, kind) for k, kind in enumerate(KINDS)]
    digit = text.rlike("[0-9]")
    at = text.rlike(r"@|[( \[{](?:at|AT)[) \]}]")
    base = [F.when(text.contains("@") if kind == "email" else digit, found_).otherwise(none) for kind, found_ in zip(KINDS, base, strict=True)]
    out = docs.withColumn("base", F.array_sort(F.concat(*base)))

    def proposed(kind: int, pattern: str) -> Column:
        hits = F.transform(found(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), x.span.alias("span"), x.before.alias("before"), x.after.alias("after")))
        return F.when(at if KINDS[kind] == "email" else digit, hits).otherwise(F.array().cast(_PROPOSED))

    def within(x: Column) -> Column:
        """The candidate, and every shorter run of it between blanks or slashes with a card's or a phone number's digits."""
        groups = let(found(x.span, r"[(+]*+[0-9](?:[().+_-]*[0-9])*+\)?"), lambda g: F.transform(g, lambda y: F.struct(y.start.alias("start"), y.end.alias("end"), F.length(_digits(y.span)).alias("digits"))))

        def runs(g: Column) -> Column:
            each = lambda i: F.transform(F.sequence(i, F.size(g) - 1), lambda j: F.struct(F.element_at(g, i + 1).start.alias("a"), F.element_at(g, j + 1).end.alias("b"), F.aggregate(F.slice(g, i + 1, j - i + 1), F.lit(0), lambda acc, y: acc + y.digits).alias("digits")))
            many = F.flatten(F.transform(F.sequence(F.lit(0), F.size(g) - 1), each))
            least, most = F.when(x.kind == 2, 13).otherwise(7), F.when(x.kind == 2, 19).otherwise(15)
            return F.filter(many, lambda r: r.digits.between(least, most) & (r.b - r.a < F.length(x.span)))

        def part(r: Column) -> Column:
            text_of = lambda a, n: F.substring(x.span, (a + 1).cast("int"), n.cast("int"))
            return F.struct(x.kind.alias("kind"), (x.start + r.a).alias("start"), (x.start + r.b).alias("end"), text_of(r.a, r.b - r.a).alias("span"), F.right(F.concat(x.before, text_of(F.lit(0), r.a)), F.lit(CONTEXT)).alias("before"), F.left(F.concat(text_of(r.b, F.length(x.span)), x.after), F.lit(CONTEXT)).alias("after"))

        one = F.array(x)
        return F.when((x.kind >= 2) & x.span.rlike("[\\x20/]"), F.concat(one, let(groups, lambda g: F.transform(runs(g), part)))).otherwise(one)

    def rated(x: Column) -> Column:
        own = features(x.kind, x.span, x.before, x.after)
        return let(F.struct(*(own[f].alias(f) for f in FEATURES)), lambda f: F.struct(model.margin(lambda name: f[name]).alias("margin"), x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))

    candidates = F.flatten(F.transform(F.concat(*(proposed(KINDS.index(kind), pattern) for kind, pattern in GENERATORS)), within))
    least = F.array(*(F.lit(float(model.thresholds[k])) for k in range(len(KINDS))))
    (more,) = spare([*docs.columns, "base", "spans"], "_more")
    out = out.withColumn(more, F.filter(F.transform(candidates, rated), lambda r: r.margin >= F.element_at(least, r.kind + 1)))
    return out.withColumn("spans", F.when(F.size(more) == 0, F.col("base")).otherwise(selected(F.col("base"), F.col(more)))).drop(more)


def selected(base: Column, more: Column) -> Column:
    """All of ``base``, and of ``more(margin, start, kind, end)``, by falling margin and then the first, each that overlaps
    none before it.

    All are sorted by their start once; where none reaches beyond a place, the array is cut, and the pieces are independent
    of each other. So the work follows the number of spans, and is quadratic in those that hang together alone.
    """
    none = F.array().cast(_SPAN)
    span = lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))
    with_margin = lambda x, m: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"), m.alias("margin"))
    merged = F.array_sort(F.concat(F.transform(base, lambda x: with_margin(x, F.lit(float("inf")))), F.transform(more, lambda x: with_margin(x, x.margin.cast("double")))))

    def pieces(m: Column, reach: Column) -> Column:
        new = lambda i: (i == 0) | (F.element_at(m, i + 1).start >= F.try_element_at(reach, i))
        first = F.filter(F.sequence(F.lit(0), F.size(m) - 1), new)
        return let(first, lambda f: F.transform(f, lambda a, k: F.slice(m, a + 1, F.coalesce(F.try_element_at(f, k + 2), F.size(m)) - a)))

    order = lambda x: F.struct((-x.margin).alias("m"), x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))
    overlap = lambda a, b: (a.start < b.end) & (b.start < a.end)
    taken = lambda acc, a: F.when((a.m > F.lit(float("-inf"))) & F.exists(acc, lambda b: overlap(a, b)), acc).otherwise(F.concat(acc, F.array(span(a))))
    best = lambda p: F.when(F.size(p) == 1, F.transform(p, span)).otherwise(F.aggregate(F.array_sort(F.transform(p, order)), none, taken))
    cut = lambda m: pieces(m, _scan(F.transform(m, lambda x: x.end), F.greatest))
    return F.when(F.size(base) + F.size(more) == 0, none).otherwise(F.array_sort(F.flatten(F.transform(let(merged, cut), best))))


def listed(column: str) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def redacted(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """``docs`` with every span of ``spans`` replaced by its kind in brackets; of overlapping spans the first counts."""
    marked = spans(docs, model)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x.start < acc["at"], acc).otherwise(F.struct(x.end.alias("at"), F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x.start - acc["at"]).cast("int")), F.element_at(names, x.kind + 1)).alias("out")))
    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return marked.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(whole))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    counts = {f"n_{kind}": count(k) for k, kind in enumerate(KINDS)}
    return marked.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
