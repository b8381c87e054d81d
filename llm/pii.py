"""Personal data: candidate spans scored by boosted trees, in DataFrame functions and Spark ML alone.

Exact formats (email, ip, card, phone) give the base spans, which always stay. High-recall generators propose
further, overlapping spans: spelled-out addresses, numbers that look like cards, phones or addresses of hosts but
miss a format's check. Boosted trees score every such proposal from its format and the text around it, in the row
that holds it; nothing but the bounded fit is shuffled.

No table labels personal data, so the trees learn from planted examples: each of at most CONTEXTS slices of the given texts (and
of a few fixed phrases, for small tables) gets rewritten forms of invented addresses, phones and cards (label 1), and
look-alikes: sentences with "at", order numbers, version numbers, impossible area codes (label 0). One in three contexts is held out
of the fit; there the threshold of each kind is the least score, LEAST or more, from which PRECISION of the examples are labelled 1.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import of_least_hash, table, written
from llm.spans import SPAN, digits, found, joined, kept, let, luhn

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST, CONTEXTS, AROUND, TREES, DEPTH, BINS = 0.98, 0.5, 1_000, 30, 10, 5, 100
#: The formats. Possessive parts and the conditions before them give the same matches in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of more proposals.
SPELLED = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[a-z0-9-]{2,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[a-z0-9-]{2,63}){1,4}"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
CARD_LIKE = r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{1,7}(?![0-9])"
IP_LIKE = r"(?<![0-9.])[0-9]{1,3}\x20?\.\x20?[0-9]{1,3}\x20?\.\x20?[0-9]{1,3}\x20?\.\x20?[0-9]{1,3}(?![0-9.])"
#: Words before a span that speak for personal data, and those that speak against it.
CUES = ("mail", "contact", "phone", "tel", "call", "mobile", "card", "pay", "visa", "ip", "host", "server", "reach", "write")
OTHER_CUES = ("order", "ref", "invoice", "isbn", "serial", "version", "build", "section", "part", "no.", "number", "id")
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "uk", "eu", "us")
#: Contexts for tables with few texts.
PHRASES = ("the report was sent out on time and we", "in the morning they went to see the", "all of this can be found in the older", "a short note for those who have", "he said that it was late, but that")


def _octets_fit(value: Column) -> Column:
    """Each part is at most 255; compared as three digits without leading zeros, for any length."""
    plain = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.lpad(plain(p), 3, "0") <= "255"))


def base_spans(text: Column) -> Column:
    """The spans of all kinds that pass their checks, as an array of SPAN's structs."""
    fits = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: _octets_fit(x["value"]),
        "card": lambda x: luhn(digits(x["value"])),
        "phone": lambda x: F.length(digits(x["value"])).between(10, 15),
    }
    may = {"email": text.contains("@"), "ip": text.rlike(IP), "card": text.rlike(CARD), "phone": text.contains("+")}
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    return F.concat(*(kept(found(text, pattern[k], k, i, may[k]), fits[k]) for i, k in enumerate(KINDS)))


def _proposals(text: Column) -> Column:
    """Further spans; what equals a base span is dropped later."""
    number = text.rlike(r"[0-9]{3}")
    return F.concat(
        found(text, SPELLED, "email", 0, text.rlike(r"(?i)[\[({\x20]at[\])}\x20]") & text.rlike(r"(?i)[\x20\[({]dot[\x20\])}]|\(at\)|\[at\]|\{at\}")),
        found(text, IP_LIKE, "ip", 1, text.rlike(r"[0-9]\x20?\.\x20?[0-9]") & text.rlike(IP_LIKE)),
        found(text, CARD_LIKE, "card", 2, number & text.rlike(CARD_LIKE)),
        found(text, LOCAL_PHONE, "phone", 3, number & text.rlike(LOCAL_PHONE)),
    )


FEATURES = ("length", "n_digits", "n_marks", "n_letters", "kind_at", "bracketed", "spelled_dot", "top_level", "issuer", "groups", "valid_codes", "octets", "cues", "other_cues", "digits_near", "after_blank")


def _features(kind_at: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """FEATURES of a proposal with the text around it, as numbers."""
    low, number, ahead = F.lower(value), digits(value), F.lower(before)
    size = lambda c, p: F.length(F.regexp_replace(c, p, ""))
    near = lambda words: reduce(lambda a, b: a + b, (ahead.rlike(rf"\b{re.escape(w)}(?![a-z])").cast("int") for w in words))
    out = [
        F.length(value), F.length(number), size(value, "[A-Za-z0-9]"), size(value, "[^A-Za-z]"), kind_at,
        low.rlike(r"[\[({](at|dot)[\])}]").cast("int"),
        low.rlike(r"[\x20\[({]dot[\x20\])}]").cast("int"),
        low.rlike(rf"[.\x20\])}}]({'|'.join(TLDS)})$").cast("int"),
        number.rlike("^(4|5[1-5]|3[47]|6011|65)").cast("int"),
        value.rlike(r"^[0-9]{4}([\x20-][0-9]{4}){3}").cast("int"),
        value.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]").cast("int"),
        F.coalesce(_octets_fit(F.regexp_replace(value, r"\x20", "")), F.lit(False)).cast("int"),
        near(CUES), near(OTHER_CUES), size(F.concat(before, after), "[^0-9]"), after.rlike(r"^[\s.,;)]|^$").cast("int"),
    ]
    return [c.cast("double") for c in out]


def planted(documents: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """``at, kind_at, value, before, after, label``: invented examples in slices of the texts of least hash, and in fixed phrases."""
    spark = documents.sparkSession
    text, h = F.col("text"), F.xxhash64("text")
    slices = documents.select(F.col("text").cast("string").alias("text")).where(F.length("text") >= 2 * AROUND)
    slices = slices.select(F.xxhash64("text").alias("at"), F.expr(f"substring(text, cast(1 + pmod(xxhash64(text), length(text) - {2 * AROUND} + 1) as int), {2 * AROUND})").alias("around"))
    fixed = spark.range(40 * len(PHRASES)).select(F.col("id").alias("at"), F.element_at(F.array(*map(F.lit, PHRASES)), (F.floor(F.col("id") / 40) + 1).cast("int")).alias("around"))
    rows = of_least_hash(slices, contexts).unionByName(fixed)
    draw = lambda k: F.xxhash64("at", "around", F.lit(k))
    pick = lambda k, *of: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in of)), (F.pmod(draw(k), F.lit(len(of))) + 1).cast("int"))
    some = lambda k, n, low=0: F.lpad((F.pmod(draw(k), F.lit(10**n - low)) + low).cast("string"), n, "0")
    word = lambda k: F.coalesce(F.get(F.filter(F.split(F.lower("around"), "[^a-z]+"), lambda w: F.length(w) >= 2), F.lit(k)), F.lit(("ann", "page", "sample")[k]))
    code = lambda k: some(k, 3, 200)  # noqa: E731  200 to 999
    good, bad, none = (lambda k: pick(k, "", "", *(f"{c} " for c in CUES))), (lambda k: pick(k, *(f"{c} " for c in OTHER_CUES))), lambda k: F.lit("")
    four = lambda k: some(k, 4)
    issuer = pick(1, F.concat(F.lit("4"), some(2, 3)), F.concat(F.lit("5"), pick(3, "1", "2", "3", "4", "5"), some(2, 2)), F.concat(F.lit("6011")))
    byte = lambda k: F.pmod(draw(k), F.lit(256)).cast("string")
    parted = lambda k, *parts: pick(k, F.concat_ws(" ", *parts), F.concat_ws("-", *parts))
    at_, dot = pick(4, " (at) ", " [at] ", "(at)", " {at} ", " at "), pick(5, " (dot) ", " [dot] ", "(dot)", " dot ")
    host, end = F.concat(word(1), some(6, 1)), pick(7, *TLDS)
    other = F.concat(word(2), F.when(word(2).isin(*TLDS), "n").otherwise(""))  # no domain's end
    area = pick(8, F.concat(F.lit("("), code(9), F.lit(") "), code(10), F.lit("-"), four(11)), F.concat_ws("-", code(9), code(10), four(11)), F.concat_ws(".", code(9), code(10), four(11)), F.concat_ws(" ", code(9), code(10), four(11)))
    made = [
        (0, 1, F.concat(word(0), at_, host, dot, end), good(20)),
        (0, 1, F.concat(word(0), at_, word(1), word(2), dot, end), good(39)),
        (0, 1, F.concat(word(0), F.lit(" at "), word(1), F.lit(" dot "), end), none(0)),
        (0, 1, F.concat(word(0), F.lit("."), word(2), at_, word(1), dot, end), none(0)),
        (0, 1, F.concat(word(0), some(12, 2), pick(13, " (at) ", "[at]", "(at)"), word(1), F.lit("."), end), none(0)),
        (0, 0, F.concat(word(0), F.lit(" at "), word(1), pick(14, ". ", "."), word(2)), good(21)),
        (0, 0, F.concat(word(0), F.lit(" at "), word(1), F.lit(". "), end), none(0)),
        (0, 0, F.concat(word(0), F.lit(" at "), word(1), F.lit(" dot "), other), none(0)),
        (0, 0, F.concat(word(0), word(2), F.lit(" at "), word(1), word(0), F.lit(" dot "), word(2), other), none(0)),
        (1, 1, F.concat_ws(" . ", byte(15), byte(16), byte(17), byte(18)), pick(22, "ip ", "host ", "server ")),
        (1, 1, F.concat_ws(" . ", byte(15), *(F.pmod(draw(k), F.lit(60)).cast("string") for k in (16, 17, 18))), pick(22, "ip ", "host ", "server ")),
        (1, 0, F.concat_ws(" . ", byte(15), byte(16), some(17, 3, 256), byte(18)), good(23)),
        (1, 0, F.concat_ws(" . ", some(15, 1), some(16, 1), some(17, 1), some(18, 1)), pick(25, "version ", "section ", "build ")),
        (2, 1, parted(26, issuer, four(27), four(28), four(29)), good(30)),
        (2, 1, F.concat(issuer, four(27), four(28), four(29)), pick(31, "card ", "visa ", "pay ")),
        (2, 0, F.concat(issuer, four(27), four(28), four(29)), none(0)),
        (2, 0, F.concat(four(32), four(27), four(28), four(29)), pick(33, "", "", *(f"{c} " for c in OTHER_CUES))),
        (2, 0, parted(26, F.concat(pick(34, "0", "1", "7", "8", "9"), some(2, 3)), four(27), four(28), four(29)), pick(33, "", *(f"{c} " for c in OTHER_CUES))),
        (3, 1, area, good(35)),
        (3, 1, area, none(0)),
        (3, 0, parted(36, F.concat(pick(37, "0", "1"), some(9, 2)), some(10, 3), four(11)), none(0)),
        (3, 0, area, bad(38)),
    ]
    examples = F.array(*(F.struct(F.lit(k).alias("kind_at"), v.alias("value"), F.concat(F.substring("around", 1, AROUND), F.lit(" "), cue).alias("before"), F.lit(float(y)).alias("label")) for k, y, v, cue in made))
    after = F.concat(F.lit(" "), F.substring("around", AROUND + 1, 9)).alias("after")
    return rows.select("at", "around", after, F.explode(examples).alias("e")).select("at", "around", "e.kind_at", "e.value", "e.before", "after", "e.label")


def _tree(lines: list[str], features: list[Column]) -> Column:
    """A column for the tree whose printed form begins ``lines``, which it uses up."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    at, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines, features)
    lines.pop(0)  # Else
    return F.when(features[int(at)] <= float(limit), low).otherwise(_tree(lines, features))


class Model:
    """Printed trees, their weights, and the least score of each kind (by its place in KINDS; above 1: none is added)."""

    def __init__(self, trees: list[str], weights: list[float], least: list[float]):
        self.trees, self.weights, self.least = trees, weights, least

    def score(self, features: list[Column]) -> Column:
        """The trees' probability, as an expression."""
        trees = (w * _tree(t.splitlines()[1:], features) for t, w in zip(self.trees, self.weights, strict=True))
        return 1 / (1 + F.exp(-2.0 * reduce(lambda a, b: a + b, trees)))

    def keeps(self, kind_at: Column, value: Column, before: Column, after: Column) -> Column:
        columns = F.struct(*(c.alias(n) for n, c in zip(FEATURES, _features(kind_at, value, before, after), strict=True)))
        limit = F.element_at(F.array(*map(F.lit, self.least)), kind_at + 1)
        return let(columns, lambda x: self.score([x[n] for n in FEATURES]) >= limit)


def fit(documents: DataFrame, contexts: int = CONTEXTS) -> Model:
    """Trees on planted examples, of at most ``contexts`` slices of the texts; see the module. A null text gives no slice."""
    rows = planted(documents, contexts)
    named = [c.alias(n) for n, c in zip(FEATURES, _features(*map(F.col, ("kind_at", "value", "before", "after"))), strict=True)]
    rows = written(rows.select(F.pmod(F.xxhash64("at", "around"), F.lit(3)).alias("third"), "label", *named))
    features = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.5, seed=7).fit(features.transform(rows.where("third > 0").repartition(1, "third").sortWithinPartitions(*FEATURES, "label")))
    scored = model.transform(features.transform(rows.where("third = 0"))).select("kind_at", "label", F.floor(vector_to_array("probability")[1] * BINS).alias("bin"))
    bins = scored.groupBy("kind_at", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # kinds x BINS at most
    least = [2.0] * len(KINDS)
    for kind_at in range(len(KINDS)):
        for b in range(int(LEAST * BINS), BINS + 1):
            above = [r for r in bins if r["kind_at"] == kind_at and r["bin"] >= b]
            if above and sum(r["good"] for r in above) >= PRECISION * sum(r["n"] for r in above):
                least[kind_at] = b / BINS
                break
    return Model([t.toDebugString for t in model.trees], list(model.treeWeights), least)


def spans_of(text: Column, model: Model) -> Column:
    """A struct of arrays of spans: ``base``, and ``spans`` with those that the trees add. A proposal inside a base span of its kind isn't added."""
    base, more = base_spans(text), _proposals(text)

    def added(b: Column, m: Column) -> Column:
        within = lambda x: F.exists(b, lambda y: (y["kind_at"] == x["kind_at"]) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]))
        before = lambda x: F.substring(text, F.greatest(F.lit(1), x["start"] - AROUND + 1), F.least(F.lit(AROUND), x["start"]))
        others = F.filter(F.array_except(m, b), lambda x: ~within(x))
        return F.filter(others, lambda x: model.keeps(x["kind_at"], x["value"], before(x), F.substring(text, x["end"] + 1, F.lit(10))))

    return let(F.struct(base.alias("base"), more.alias("more")), lambda z: F.struct(z["base"].alias("base"), F.when(F.size(z["more"]) == 0, z["base"]).otherwise(F.array_union(z["base"], added(z["base"], z["more"]))).alias("spans")))


def personal_data(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, base, spans`` for every row of documents (null text: empty): arrays of spans, ``spans`` with those the trees add.

    The model is fitted on the same documents unless it is given. Columns other than ``doc_id`` and ``text`` aren't read; repeated rows give repeated rows.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", spans_of(F.col("text"), model or fit(documents)).alias("s")).select("doc_id", "s.base", "s.spans")


def _redacted(text: Column, spans: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        mark = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["text"], gap, mark).alias("text"))

    clean = lambda s: F.aggregate(F.array_sort(s), start, step, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))))
    return let(spans, lambda s: F.when(F.size(s) > 0, clean(s)).otherwise(text))


def redacted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """documents with every span of personal data in ``text`` replaced by its kind in brackets; spans that overlap become one.

    Each text is redacted in its own row. All columns stay as they are but ``text`` (null stays null) and ``n_chars``, which follows it where it is there.
    """
    model = model or fit(documents)
    text = F.col("text").cast("string")
    clean = _redacted(text, spans_of(text, model)["spans"])
    out = documents.withColumn("text", F.when(text.isNotNull(), clean))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans, for every row of ``documents``.

    Null texts read as empty and have no spans; texts are read whole, however long. Rows that repeat are scored each; where spans tie on a start they are in the order of the kinds. Other columns
    aren't read; an empty table gives none.
    """
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
