"""Places of regex matches in whole texts, in DataFrame functions alone.

A match list and the pieces between the matches come from the same expression, so
the lengths of both, in code points, give every match's place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind_at:int,kind:string,end:int,value:string>>"


def found(text: Column, pattern: str, kind: str, kind_at: int, may: Column | None = None) -> Column:
    """All matches of ``pattern``, leftmost and not overlapping, as an array of SPAN's structs.

    may: a cheap condition that holds wherever there is a match; other texts are passed over. Lists are built in blocks of about
    the root of the number of matches, since each step copies the list that it adds to.
    """
    none = F.array().cast(SPAN)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    pairs = F.transform(F.filter(pairs, lambda x: x["value"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["value"].alias("value")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        one = F.struct(begin.alias("start"), F.lit(kind_at).alias("kind_at"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    def placed(p: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(p))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / n).cast("int")), lambda b: F.slice(p, b * n + 1, n))
        sized = F.transform(blocks, lambda b: F.struct(b.alias("rows"), F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["value"])).alias("size")))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = lambda z: F.aggregate(z, first, lambda acc, x: F.struct((acc["at"] + x["size"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        spans = lambda x, at: F.aggregate(x["rows"], F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
        return let(sized, lambda z: F.flatten(F.zip_with(z, starts(z), spans)))

    matched = let(pairs, lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(none))
    return F.when(may if may is not None else F.lit(True), matched).otherwise(none)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kept(spans: Column, test) -> Column:
    return F.filter(spans, test)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind_at"].alias("kind_at"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    back = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0
