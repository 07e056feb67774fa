"""Personal data in texts: rules, high-recall candidates, boosted trees and calibrated thresholds, all in native expressions.

Four kinds are looked for: email, ip, card, phone. BASE has the rule of each kind; its
spans always stay. GENERATORS propose more spans, which may overlap each other and those
of the rules: obfuscated addresses, numbers that a rule swallows together with their
neighbours, numbers without a plus. A candidate has ten small features of its format and
context (features()) and, where a check or a telling form decides, a label (labelled());
the others are unlabelled. Spark's gradient-boosted trees learn from the labelled ones,
counted by their features over all documents (no sample; the table has a row for each
combination of features that occurs, 8 million at the very most and some thousands in
practice). Documents of the fold HELD (crc32 of the id) are left out of training and give each
kind its threshold: the lowest score of LEAST or more at which PRECISION of the labelled
candidates at or above it are positive. Candidates that reach their kind's threshold and are not labelled 0 are added where they
overlap no span of a rule; of added ones that overlap, the first stays, and of those with
the same start the longest.

Texts are read once, for spans and features; the trees run over that table. There is no
shuffle of texts and no Python on the executors. Positions are code points, from the
lengths of what a pattern matches and of what lies between; a text with n matches takes
O(n) regular expression work and prefix sums in blocks of 64. Patterns are possessive, so
that very long runs need no stack, and can't start inside a run twice.

Nulls: a null text is empty and has no spans; a null id belongs to the training part.
Rows with the same id keep apart. Where a kind has no labelled candidates of both sorts in
training or none in the held part, only the rules' spans are given. Empty tables give no
rows. Extra columns are ignored by find(), kept by redact().
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoform.llm._spark import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = "[A-Za-z0-9._%+-]"
#: A run is tried from its start, or from where the match before it ended.
_START = rf"(?:\G|(?<!{_LOCAL}))"
BASE = (
    rf"{_START}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_OPEN, _CLOSE = r"[\x20]?[(\[{<][\x20]?", r"[\x20]?[)\]}>][\x20]?"
_AT = rf"(?:@|{_OPEN}(?:at|@){_CLOSE}|[\x20](?:at|@)[\x20])"
_DOT = rf"(?:\.|{_OPEN}(?:dot|\.){_CLOSE}|[\x20]dot[\x20])"
GENERATORS = (
    (EMAIL, rf"(?i){_START}{_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    (IP, rf"(?i)(?<![0-9])[0-9]{{1,4}}+(?:(?:{_DOT}|[,:_-])[0-9]{{1,4}}+){{3}}"),
    (IP, r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])"),
    (CARD, r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}([\x20./_-])[0-9]{6}\1[0-9]{4,5}+(?![0-9])"),
    (PHONE, r"(?<![0-9+])(?:\+?1[\x20.-]?)?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    (PHONE, r"(?:\+|(?<![0-9])00)[\x20]?[1-9][0-9]{0,2}(?:[\x20.()-]{1,2}[0-9]{2,4}){2,5}(?![0-9])"),
)
# Words that tell the kind of what follows, and words that speak against all of them.
CUES = (
    ("e-mail", "email", "mail", "mailto", "contact", "write", "courriel", "correo"),
    ("ip", "host", "server", "address", "adresse", "client", "login"),
    ("card", "credit", "debit", "visa", "mastercard", "amex", "carte", "karte", "tarjeta"),
    ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "sms", "whatsapp", "telefon", "téléphone", "teléfono"),
    ("version", "ver", "release", "build", "order", "invoice", "isbn", "sku", "ref", "section", "date"),
)
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CUE = r"(?i)(?<![\p{L}])(" + "|".join(w for words in CUES for w in words) + r")(?![\p{L}])"
#: Fold of ids (crc32 modulo FOLDS is 0) that only calibrates, and the precision that a threshold has to reach there.
FOLDS, PRECISION, LEAST = 5, 0.99, 0.5
TREES, LEVELS, STEP = 20, 3, 0.3
#: Characters kept of what lies before a candidate.
BEFORE = 32
SPAN = "struct<s: int, k: int, e: int>"
_NUMBER = "struct<s: int, k: int, e: int, label: int, f: array<int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column) -> Column:
    """Sums of an array of ints up to each element, by blocks of 64."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = lambda st: F.transform(F.sequence(F.lit(0), F.floor((F.size(st) - 1) / 64).cast("int")), lambda b: total(F.slice(st, b * 64 + 1, F.lit(64))))
    before = lambda bs: F.transform(bs, lambda x, i: total(F.slice(bs, F.lit(1), i)))
    sums = lambda st: let(let(blocks(st), before), lambda bp: F.transform(st, lambda x, i: F.get(bp, F.floor(i / 64).cast("int")) + total(F.slice(st, i - i % 64 + 1, i % 64 + 1))))
    return let(steps, sums)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    digit = lambda i: F.ascii(F.substr(d, F.length(d) - i + 1, F.lit(1))) - 48
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))) % 10 == 0


def octets(v: Column) -> Column:
    return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _valid(kind: int, v: Column) -> Column:
    """What a rule asks of a match beside its pattern."""
    if kind == IP:
        return octets(v)
    if kind == CARD:
        return let(digits(v), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    return F.length(digits(v)).between(10, 15) if kind == PHONE else F.lit(True)


def _matches(text: Column, pattern: str, hits: str) -> Column:
    """Array of (s, e, v, before, after) of a pattern's matches, given their texts: before and after end at the neighbouring matches."""
    found = F.col(hits)

    def spans(gaps: Column) -> Column:
        n = F.size(found)
        length = lambda a: F.transform(a, F.length)
        steps = F.zip_with(F.slice(length(gaps), F.lit(1), n), F.concat(F.array(F.lit(0)), F.slice(length(found), F.lit(1), n - 1)), lambda a, b: a + b)
        beside = F.zip_with(F.transform(F.slice(gaps, F.lit(1), n), lambda g: F.right(g, F.lit(BEFORE))), F.transform(F.slice(gaps, F.lit(2), n), lambda g: F.left(g, F.lit(1))), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        placed = F.zip_with(found, running(steps), lambda v, s: F.struct(s.cast("int").alias("s"), (s + F.length(v)).cast("int").alias("e"), v.alias("v")))
        return F.zip_with(placed, beside, lambda p, b: F.struct(p["s"].alias("s"), p["e"].alias("e"), p["v"].alias("v"), b["before"].alias("before"), b["after"].alias("after")))

    return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), spans)).otherwise(F.array().cast("array<struct<s: int, e: int, v: string, before: string, after: string>>"))


def _near(c: Column) -> Column:
    """Class of the character next to a candidate: 0 none or space, 1 letter, 2 digit, 3 other."""
    return F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def _cue(before: Column) -> Column:
    """0 for no cue word before a candidate, else the number (from 1) of the list that has the last one."""
    words = F.regexp_extract_all(before, F.lit(_CUE), F.lit(1))
    last = F.lower(F.when(F.size(words) > 0, F.element_at(words, -1)))
    out = F.when(last.isNull(), 0)
    for i, listed in enumerate(CUES):
        out = out.when(last.isin(*listed), i + 1)
    return out.otherwise(0)


def features(kind: int, v: Column, before: Column, after: Column) -> Column:
    """Ten small numbers: kind, digits, groups, style, check, what is before and after, cue, first and last group."""
    d = F.length(digits(v))
    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    many = F.when(d < 7, 0).when(d < 10, 1).when(d < 13, 2).when(d < 16, 3).when(d == 16, 4).when(d < 20, 5).otherwise(6)
    style = F.when(v.contains("("), 4).when(v.rlike(r"[\[{<]"), 4).when(v.contains(" "), 1).when(v.contains("-"), 2).when(v.contains("."), 3).otherwise(0)
    if kind == EMAIL:
        style = F.when(v.rlike(r"[(\[{<]"), 4).when(~v.contains(" "), 0).when(v.rlike("(?i) dot "), 2).when(v.contains("@"), 3).otherwise(1)
        check = v.rlike(r"(?:\.|[^A-Za-z0-9-])[A-Za-z]{2,10}$")
    elif kind == IP:
        check = octets(v) | v.rlike("^[0-9A-Fa-f:]+$") & (F.size(F.split(v, ":")) == 8)
    elif kind == CARD:
        check = luhn(digits(v))
    else:
        check = v.rlike(r"^(?:\+|\(|00)")
    size = lambda g: F.least(F.coalesce(F.length(g), F.lit(0)), F.lit(4))
    return F.array(F.lit(kind), many, F.least(F.size(groups), F.lit(5)), style, check.cast("int"), _near(F.right(before, F.lit(1))), _near(after), _cue(before), size(F.get(groups, F.lit(0))), size(F.when(F.size(groups) > 0, F.element_at(groups, -1))))


def labelled(kind: int, v: Column, f: Column) -> Column:
    """1 or 0 where a check or a telling form decides, else null."""
    d, apart, cue = F.length(digits(v)), ~F.get(f, F.lit(5)).isin(1, 2) & ~F.get(f, F.lit(6)).isin(1, 2), F.get(f, F.lit(7))
    check, style = F.get(f, F.lit(4)) == 1, F.get(f, F.lit(3))
    if kind == EMAIL:
        return F.when(~check, 0).when(style.isin(0, 2, 4), 1).when((style == 1) & v.rlike("(?i)^[a-z]+ at "), 0)
    if kind == IP:
        return F.when(~check & v.rlike("^[0-9.]+$"), 0).when(~apart | (cue == len(CUES)), 0).when(check, 1)
    if kind == CARD:
        return F.when(check & apart & d.between(14, 19), 1).otherwise(0)
    return F.when(~apart | ~d.between(7, 15) | (cue == len(CUES)) | (cue == CARD + 1), 0).when(v.startswith("+") & d.between(10, 15), 1).when((cue == PHONE + 1) & d.between(10, 11) & (style > 0), 1)


def candidates(documents: DataFrame, text: str = "text", key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """key, held, base (spans of the rules, in order) and found (candidates with label and features) of every row."""
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    patterns = [*enumerate(BASE), *GENERATORS]
    # Cheap tests first, so that most texts are not searched for what they cannot hold.
    fits = {EMAIL: F.col("text").rlike("(?i)@|at"), IP: F.col("text").rlike("[0-9]"), CARD: F.col("text").rlike("[0-9]"), PHONE: F.col("text").rlike("[0-9]")}
    hits = [F.when(F.col("text").contains("@") if p is BASE[EMAIL] else F.col("text").contains("+") if p is BASE[PHONE] else fits[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"h{i}") for i, (k, p) in enumerate(patterns)]
    rows = rows.select("*", *hits)
    spans = [_matches(F.col("text"), p, f"h{i}") for i, (_, p) in enumerate(patterns)]

    def kept(kind: int) -> Column:
        return F.transform(F.filter(spans[kind], lambda m: _valid(kind, m["v"])), lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e")))

    base = F.array_sort(F.concat(*[kept(k) for k in range(4)]))

    def proposed(kind: int, matches: Column) -> Column:
        made = lambda m, f: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e"), labelled(kind, m["v"], f).cast("int").alias("label"), f.alias("f"))
        return F.transform(matches, lambda m: let(features(kind, m["v"], m["before"], m["after"]), lambda f: made(m, f)))

    found = F.concat(*[proposed(k, spans[i]) for i, (k, _) in enumerate(patterns) if i >= len(BASE)])
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return rows.select("key", held.alias("held"), base.cast(f"array<{SPAN}>").alias("base"), found.cast(f"array<{_NUMBER}>").alias("found"), *[f"c{i}" for i in range(len(carried))])


def tree_expression(lines: list[str], feature: Callable[[int], Column]) -> Column:
    """A printed tree as nested conditions; takes its lines off the list."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    test = re.fullmatch(r"If \(feature (\d+) <= ([-+.\deE]+)\)", line)
    left = tree_expression(lines, feature)
    lines.pop(0)  # Else
    return F.when(feature(int(test[1])) <= float(test[2]), left).otherwise(tree_expression(lines, feature))


class Model:
    """Boosted trees as a native expression over the features of a candidate, and a threshold for each kind that has one."""

    def __init__(self, printed: str | None, weights: list[float], thresholds: dict[int, float]):
        self.printed, self.weights, self.thresholds = printed, weights, thresholds

    def score(self, f: Column) -> Column:
        """Probability that a candidate is personal data."""
        if not self.printed:
            return F.lit(0.0)
        trees = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", "\n" + self.printed)[1:]
        parts = [F.lit(w) * tree_expression(t.rstrip("\n").split("\n"), lambda i: F.get(f, F.lit(i))) for w, t in zip(self.weights, trees, strict=True)]
        margin = parts[0]
        for p in parts[1:]:
            margin = margin + p
        return 1 / (1 + F.exp(-2 * margin))

    def reaches(self, kind: Column, f: Column) -> Column:
        """Whether a candidate reaches its kind's threshold."""
        need = F.lit(2.0)
        for k, t in self.thresholds.items():
            need = F.when(kind == k, F.lit(t)).otherwise(need)
        return self.score(f) >= need


def fit(rows: DataFrame, precision: float = PRECISION) -> Model:
    """Trees and thresholds from the labelled candidates of all rows, counted by their features."""
    seen = rows.select("held", F.explode("found").alias("c")).where("c.label is not null")
    table = written(seen.groupBy("held", F.col("c.f").alias("f"), F.col("c.label").alias("label")).agg(F.count("*").cast("double").alias("n")), "candidates")
    train = table.where("not held").select(array_to_vector(F.col("f").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), "n", "f")
    if len(train.select("label").distinct().collect()) < 2:
        return Model(None, [], {})
    # In one order, so that reruns give the same trees; a row for each combination of features.
    train = train.repartition(1).sortWithinPartitions("f", "label")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=LEVELS, stepSize=STEP, seed=11).fit(train)
    model = Model(trees.toDebugString, list(trees.treeWeights), {})
    scored = table.where("held").select(F.get("f", F.lit(0)).alias("k"), F.round(model.score(F.col("f")), 9).alias("score"), "label", "n")
    levels = scored.groupBy("k", "score").agg(F.sum(F.col("n") * F.col("label")).alias("yes"), F.sum("n").alias("all"))
    above = Window.partitionBy("k").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = levels.select("k", "score", (F.sum("yes").over(above) / F.sum("all").over(above)).alias("p")).where((F.col("p") >= precision) & (F.col("score") >= LEAST))
    model.thresholds = {r["k"]: r["t"] - 1e-9 for r in reached.groupBy("k").agg(F.min("score").alias("t")).collect()}
    return model


def _apart(spans: Column) -> Column:
    """Spans (s, order, k, e) in order without those that start before the one before them ends."""
    step = lambda kept, c: F.when((F.size(kept) == 0) | (c["s"] >= F.element_at(kept, -1)["e"]), F.array_append(kept, F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))).otherwise(kept)
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def select(rows: DataFrame, model: Model) -> DataFrame:
    """rows of candidates() with spans: those of the rules and the added ones, in order."""
    plain = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))
    chosen = F.filter("found", lambda c: (F.coalesce(c["label"], F.lit(1)) == 1) & model.reaches(c["k"], c["f"]))
    new = F.array_except(F.transform(chosen, plain), F.col("base"))
    rows = rows.withColumn("_new", new)
    free = F.filter("_new", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    ordered = F.array_sort(F.transform(free, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("o"), c["k"].alias("k"), c["e"].alias("e"))))
    added = let(ordered, _apart)
    return rows.withColumn("_added", F.when(F.size("_new") > 0, added).otherwise(F.array().cast(f"array<{SPAN}>"))).withColumn("spans", F.array_sort(F.concat("base", "_added"))).drop("_new", "_added")


def find(documents: DataFrame, text: str = "text", key: str = "doc_id", precision: float = PRECISION, carried: tuple[str, ...] = ()) -> DataFrame:
    """key, base and spans (arrays of start, kind number, end) of every row."""
    rows = written(candidates(documents, text, key, carried), "personal")
    return select(rows, fit(rows, precision)).drop("found", "held")


def redact(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """documents with every span of their texts replaced by its kind in square brackets; overlapping spans become one, named by the first."""
    found = find(documents, text, key, carried=tuple(documents.columns))
    merge = lambda kept, c: F.when((F.size(kept) == 0) | (c["s"] >= F.element_at(kept, -1)["e"]), F.array_append(kept, c)).otherwise(F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), F.struct(F.element_at(kept, -1)["s"].alias("s"), F.element_at(kept, -1)["k"].alias("k"), F.greatest(F.element_at(kept, -1)["e"], c["e"]).alias("e"))))
    own = F.col(f"c{documents.columns.index(text)}")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def cut(merged: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["e"]))
        ends = F.concat(F.transform(merged, lambda m: m["s"]), F.array(F.length(own)))
        kept = F.zip_with(starts, ends, lambda a, b: F.substr(own, a + 1, b - a))
        marks = F.concat(F.transform(merged, lambda m: F.get(names, m["k"])), F.array(F.lit("")))
        return F.array_join(F.zip_with(kept, marks, lambda t, m: F.concat(t, m)), "")

    clean = F.when(F.size("spans") > 0, let(F.aggregate("spans", F.array().cast(f"array<{SPAN}>"), merge), cut)).otherwise(own)
    return found.select(*[(clean if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(documents.columns)])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda k: F.size(F.filter("base", lambda c: c["k"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
