"""Secret scans: known formats, and a battery of randomness tests over other long strings, in DataFrame functions alone.

Every string of 16 or more key characters gets an encoding (hex, base 26, 32, 36 or 64) by its letters and digits; marks between
them are passed over. Three tests hold it against equal chances within that alphabet: chi-squared of the character counts, runs of
one kind of character (upper, lower, digit), and the serial correlation of neighbours. Fisher's sum of their logs is small for
random strings. What it is for ordinary identifiers is learned from a background: identifiers built from the words of all texts
and from numbers, cut to the lengths of each class. A string's p-value is the chance that an ordinary identifier of its encoding and class
of length looks as random; within each class of length the Benjamini-Hochberg procedure bounds false discoveries at LEVEL, and
what it rejects as ordinary is reported as ``random``. Spans of known formats always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table, written
from llm.spans import SPAN, found, joined, kept

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
STRING = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Level of the bound, lengths at which a class ends, and bins of -log10 p.
LEVEL, CLASSES, PER_DECADE, MOST = 0.01, (20, 24, 32, 48, 96), 50, 12
#: Words that a stretch of the background is built of (their letters about fill one identifier of each class), and the background strings that a class needs to be judged by its own.
IDENTIFIER_WORDS, ENOUGH = 40, 10
ALPHABETS = {"hex": "0123456789abcdef", "base26": "abcdefghijklmnopqrstuvwxyz", "base32": "abcdefghijklmnopqrstuvwxyz234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}


def base_spans(text: Column) -> Column:
    assigned = kept(found(text, ASSIGN, "assign", 0, text.rlike(r"(?i)password|passwd|secret|token|api_?key")), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN_VALUE, 1)) >= 8)
    access = kept(found(text, ACCESS, "access", 1, text.contains("AKIA")), lambda x: F.length(x["value"]) >= 16)
    return F.concat(assigned, access, found(text, HEX, "hex", 2, text.rlike(HEX)))


def _log_tail(z: Column) -> Column:
    """Log of the normal distribution's upper tail, by the usual logistic fit of it."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return -F.log1p(F.exp(1.5976 * z + 0.07056 * z * z * z))


def _kind_chances(letters: str) -> tuple[float, float]:
    """Sums of the squares and cubes of the chances of upper case, lower case and digits."""
    n = len(letters)
    p = [sum(c.isupper() for c in letters) / n, sum(c.islower() for c in letters) / n, sum(c.isdigit() for c in letters) / n]
    return sum(x**2 for x in p), sum(x**3 for x in p)


def battery(strings: DataFrame) -> DataFrame:
    """Adds ``encoding``, the logs of the tests' p-values (``uniform``, ``runs``, ``serial``) and ``fisher``, -2 times their sum, to ``value``.

    Strings without an encoding (digits alone, fewer than 8 letters and digits) go. A string of one repeated character has no variance: its
    serial correlation is as far from chance as can be.
    """
    core = F.regexp_replace("value", "[^A-Za-z0-9]", "")
    out = strings.withColumn("_core", core).where("length(_core) >= 8")
    c = F.col("_core")
    encoding = (
        F.when(c.rlike("^[0-9]+$"), F.lit(None)).when(c.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(c.rlike("^([a-z]+|[A-Z]+)$"), "base26").when(c.rlike("^[A-Z2-7]+$"), "base32")
        .when(c.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36").otherwise("base64")
    )
    out = out.withColumn("encoding", encoding).where("encoding is not null")
    by = lambda f: F.element_at(F.create_map(*(F.lit(x) for name, letters in ALPHABETS.items() for x in (name, f(letters)))), F.col("encoding"))
    shown = F.when(F.col("encoding") == "base64", c).otherwise(F.lower(c))
    out = out.withColumns({"_k": by(len).cast("double"), "_letters": by(str), "_s2": by(lambda x: _kind_chances(x)[0]), "_s3": by(lambda x: _kind_chances(x)[1])})
    out = out.withColumn("_x", F.transform(F.split(shown, ""), lambda y: (F.instr(F.col("_letters"), y) - 1).cast("double"))).withColumn("_n", F.size("_x").cast("double"))
    n, k, s2, s3 = F.col("_n"), F.col("_k"), F.col("_s2"), F.col("_s3")
    # squares of the counts in one pass over the sorted characters: the r-th of a run of equal ones adds 2 r - 1
    run = lambda a, y: F.when(a["v"] == y, a["r"] + 1.0).otherwise(F.lit(1.0))
    begin = F.struct(F.lit(-1.0).alias("v"), F.lit(0.0).alias("r"), F.lit(0.0).alias("t"))
    squares = F.aggregate(F.sort_array("_x"), begin, lambda a, y: F.struct(y.alias("v"), run(a, y).alias("r"), (a["t"] + 2.0 * run(a, y) - 1.0).alias("t")), lambda a: a["t"])
    chi2 = k / n * squares - n
    uniform = _log_tail((chi2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    # changes of kind: each stretch of one kind is one character, so the length less one is the number of changes
    changes = F.length(F.regexp_replace(c, "(?<=[A-Z])[A-Z]+|(?<=[a-z])[a-z]+|(?<=[0-9])[0-9]+", "")) - 1
    spread = (n - 1) * (1 - s2) * s2 + 2 * (n - 2) * (s3 - s2 * s2)
    runs = F.when(s2 > 0.999, F.lit(0.0)).otherwise(_log_tail(-(changes - (n - 1) * (1 - s2)) / F.sqrt(F.greatest(spread, F.lit(1e-9)))))
    out = out.withColumns({"uniform": uniform, "runs": runs, "_mean": F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / n})
    mean = F.col("_mean")
    head, next_ = F.slice("_x", F.lit(1), F.size("_x") - 1), F.slice("_x", F.lit(2), F.size("_x") - 1)
    product = F.aggregate(F.zip_with(head, next_, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, v: a + v)
    out = out.withColumns({"_v": F.aggregate("_x", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), "_p": product})
    out = out.withColumn("serial", F.when(F.col("_v") > 0, F.least(F.lit(0.0), math.log(2) + _log_tail(F.abs(F.col("_p") / F.col("_v") + 1 / n) * F.sqrt("_n")))).otherwise(_log_tail(F.lit(8.0))))
    out = out.withColumn("fisher", -2 * (F.col("uniform") + F.col("runs") + F.col("serial")))
    return out.drop("_core", "_k", "_letters", "_s2", "_s3", "_x", "_n", "_mean", "_v", "_p")


def _size_class(value: Column) -> Column:
    """The class of a string's length in letters and digits."""
    n, out = F.length(F.regexp_replace(value, "[^A-Za-z0-9]", "")), F.lit(len(CLASSES))
    for i, end in reversed(list(enumerate(CLASSES))):
        out = F.when(n < end, i).otherwise(out)
    return out


def background(documents: DataFrame, words_each: int = IDENTIFIER_WORDS) -> DataFrame:
    """``value``: the different ordinary identifiers that the words of all texts and a few fixed words make, of every encoding and class of length.

    All words of three letters or more that more than one text holds (what one text alone has may be a piece of a secret) count once each, whatever their case. By their hashes they
    are dealt out to stretches of about ``words_each``; a stretch gives in every form one identifier for each class of length, one after the other.
    """
    spark = documents.sparkSession
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 3))
    texts = documents.select(F.col("text").cast("string").alias("text")).where("text is not null")
    vocabulary = written(texts.select(F.explode(words).alias("w"), F.xxhash64("text").alias("of")).groupBy("w").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b").select("w"))
    bucket = F.pmod(F.xxhash64("w", F.lit(1)), F.lit(vocabulary.count() // words_each + 1))
    stretches = vocabulary.groupBy(bucket.alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("w").alias("h"), "w")))["w"].alias("w")).where("size(w) > 3")
    fixed = "get element factory report final quarter invoice number chapter section page user account service handler default request response client server config index table value count total monthly summary draft version release build module package image header footer session manager controller".split()
    listed, turn = F.array(*map(F.lit, fixed)), (F.col("id") % len(fixed)).cast("int")
    rotated = spark.range(160).select((-1 - F.col("id")).alias("at"), F.concat(F.slice(listed, turn + 1, F.lit(len(fixed))), F.slice(listed, F.lit(1), turn)).alias("w"))
    draw = lambda k, n: F.pmod(F.xxhash64("at", F.lit(k)), F.lit(n)).cast("int")
    n_forms = 8
    rows = stretches.unionByName(rotated).withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(n_forms - 1))))
    number = lambda k: F.element_at(F.array(F.lit(""), F.lpad(draw(k, 100).cast("string"), 2, "0"), (draw(k, 40) + 1990).cast("string"), draw(k, 10).cast("string"), F.lpad(draw(k, 100_000).cast("string"), 8, "0")), draw(k + 50, 5) + 1)
    rows = rows.withColumns({"_one": draw(1, 3), "_two": draw(3, 3), "_n": number(2), "_m": number(4)})
    rows = rows.select("at", "form", F.array_join(F.transform("w", lambda x, i: F.concat(F.initcap(x), F.when(i % 3 == F.col("_one"), F.col("_n")).when(i % 3 == F.col("_two"), F.col("_m")).otherwise(""))), "").alias("camel"))
    camel = F.col("camel")
    lower, upper, letters = F.lower(camel), F.upper(camel), F.regexp_replace(camel, "[0-9]", "")
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat((F.pmod(F.xxhash64("at", i), F.lit(60)) + 1970).cast("string"), F.lpad(F.pmod(F.xxhash64(i, "at"), F.lit(13)).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, ("", "000", "a", "bad", "face", "added", "f", "decade", "dead", "beef"))), (F.pmod(F.xxhash64("at", i, F.lit(1)), F.lit(10)) + 1).cast("int")))), "")
    base32 = F.regexp_replace(upper, "[0189]", "2")
    long = F.when(F.col("form") == 0, camel)
    for k, form in enumerate((lower, upper, letters, F.lower(letters), F.upper(letters), numbers, base32), 1):
        long = long.when(F.col("form") == k, form)
    ends = (16, *CLASSES, 160)
    length = lambda i: F.lit(ends[i]) + F.pmod(F.xxhash64("at", "form", F.lit(i)), F.lit(ends[i + 1] - ends[i])).cast("int")
    rows = rows.select(long.alias("long"), *(length(i).alias(f"_{i}") for i in range(len(ends) - 1)))
    cuts = F.array(*(F.substring("long", sum((F.col(f"_{k}") for k in range(i)), F.lit(1)), F.col(f"_{i}")) for i in range(len(ends) - 1)))
    return rows.select(F.explode(cuts).alias("value")).where("length(value) >= 16").distinct()


def random_strings(strings: DataFrame, ordinary: DataFrame, level: float = LEVEL) -> DataFrame:
    """The rows of ``strings`` whose ``value`` isn't an ordinary identifier, with false discoveries bounded at ``level`` within each class of length.

    ordinary: ``value``, as from ``background``. The log of Fisher's sum is taken as normal, with the mean and deviation
    of the ordinary strings of the same encoding and class. Where there are fewer than ENOUGH of them, those of the encoding at any length count, and where they are too few too, all ordinary
    strings. Without ENOUGH ordinary strings at all nothing can be told from them, and nothing is reported.
    """
    log = F.log(F.greatest(F.col("fisher"), F.lit(1e-3)))
    rows = battery(ordinary).withColumn("size_class", _size_class(F.col("value"))).withColumn("log", log)
    sums = written(rows.groupBy("encoding", "size_class").agg(F.count("*").alias("n"), F.sum("log").alias("s"), F.sum(F.col("log") * F.col("log")).alias("q")))  # encodings x classes at most
    total, n, q = F.sum("s"), F.sum("n"), F.sum("q")
    moments = lambda suffix: (F.round(total / n, 9).alias(f"_m{suffix}"), F.round(F.sqrt(F.greatest(F.lit(0.0), (q - total * total / n) / F.greatest(n - 1, F.lit(1)))), 9).alias(f"_s{suffix}"), n.alias(f"_n{suffix}"))
    grid = strings.sparkSession.range(len(CLASSES) + 1).select(F.col("id").cast("int").alias("size_class"), F.explode(F.array(*map(F.lit, ALPHABETS))).alias("encoding"))
    known = grid.join(sums.groupBy("encoding", "size_class").agg(*moments("")), ["encoding", "size_class"], "left").join(sums.groupBy("encoding").agg(*moments(1)), "encoding", "left").crossJoin(sums.agg(*moments(2)))  # a few rows
    pick = lambda c: F.when(F.col("_n") >= ENOUGH, F.col(f"_{c}")).when(F.col("_n1") >= ENOUGH, F.col(f"_{c}1")).when(F.col("_n2") >= ENOUGH, F.col(f"_{c}2")).alias(f"_{c}")
    known = written(known.select("encoding", "size_class", pick("m"), pick("s")).where("_m is not null"))  # encodings x classes at most
    tested = battery(strings).withColumn("size_class", _size_class(F.col("value"))).join(F.broadcast(known), ["encoding", "size_class"])
    p = F.exp(_log_tail((F.col("_m") - log) / F.greatest(F.col("_s"), F.lit(0.05))))
    tested = written(tested.withColumn("bin", F.floor(F.least(F.lit(float(MOST)), -F.log10(F.greatest(p, F.lit(1e-12)))) * PER_DECADE).cast("int")).drop("_m", "_s"))
    counts = tested.groupBy("size_class", "bin").count().collect()  # classes x bins at most
    bound = F.lit(MOST * PER_DECADE + 1)
    for c in {r["size_class"] for r in counts}:
        of = sorted(((r["bin"], r["count"]) for r in counts if r["size_class"] == c), reverse=True)
        total, reported, least = sum(n for _, n in of), 0, None
        for b, n in of:
            reported += n
            if math.pow(10, -b / PER_DECADE) <= level * reported / total:
                least = b
        if least is not None:
            bound = F.when(F.col("size_class") == c, F.lit(least)).otherwise(bound)
    return tested.where(F.col("bin") >= bound).drop("bin", "size_class")


def secret_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for every row of documents (null text: empty): arrays of spans, ``spans`` with the random strings too.

    A random string that touches a base span isn't added. Rows that share id and text have equal spans.
    Columns other than ``doc_id`` and ``text`` aren't read.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = docs.withColumn("base", base_spans(F.col("text"))).withColumn("more", found(F.col("text"), STRING, "random", 3, F.col("text").rlike(STRING)))
    touches = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    rows = written(both.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", F.filter("more", lambda x: ~touches(x)).alias("more")))
    strings = rows.where(F.size("more") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("more").alias("s")).select("doc_id", "text_hash", "s.*")
    added = random_strings(strings, background(documents)).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(
        F.collect_set(F.struct("start", "kind_at", "kind", "end", "value")).cast(SPAN).alias("added")
    )
    rows = rows.join(added, rows["doc_id"].eqNullSafe(added["_d"]) & (rows["text_hash"] == added["_h"]), "left")
    return rows.select("doc_id", "base", F.array_union("base", F.coalesce("added", F.array().cast(SPAN))).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans, for every row of ``documents``.

    Null texts read as empty and have no spans; texts are read whole, however long. Rows that share id and text have equal spans, null ids too. Strings that tie with the bound are
    reported. Other columns aren't read; an empty table gives none.
    """
    spans = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
