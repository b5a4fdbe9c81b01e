"""The best value of each field among rival states of one record (problem 4).

Method: fields are unpivoted to long rows; every row votes for its normalised value with the trust in its source
times the decay of its age; votes are summed per value; max_by picks the winning value; the winners are pivoted back.

Votes are whole numbers, so sums do not depend on their order. Where source, then time, then number must decide without
exception, trust and decay are made steep enough for it: with n rows that vote on a field, a user's vote is worth n + 1
of the extractor's, and the newest vote of either source n + 1 times one that has not decayed, so that the newest vote
of the better source outweighs the sum of all others. Both forms are one operator.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans.scratch import Scratch
from kgspark.plans.skew import lookup

#: Words that stand for "no value", letters and digits only, lower case.
NO_VALUE = (
    "na", "null", "none", "nil", "nan", "nul", "unknown", "unk", "undefined", "undef", "tbd", "tba", "tbc", "todo",
    "notavailable", "notapplicable", "notspecified", "unspecified", "notknown", "notset", "unset", "novalue",
    "nodata", "missing", "empty", "blank", "void", "notgiven", "notprovided", "noinformation", "noinfo",
)
#: Moves the first microsecond of the year 1 to 0; places of the parts of precedence().
MICROS_SHIFT = 62_135_596_800_000_000
PLACE = Decimal(10) ** 19
TOP = Decimal(10) ** 37
#: A vote of the extractor that has not decayed; sums of a value's votes are 64-bit numbers, room for 8 billion of them.
UNIT = 1 << 30


def no_value(c: Column) -> Column:
    """True for null, blank text, text without any letter or digit, and words that stand for "no value"."""
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return c.isNull() | (bare == "") | bare.isin(*NO_VALUE)


def precedence(edited: Column, at: Column, number: Column) -> Column:
    """One ordered number: edited rows first, then the later time (null last), then the larger number (0 or more)."""
    micros = F.coalesce(F.unix_micros(at.cast("timestamp")) + F.lit(MICROS_SHIFT + 1), F.lit(0)).cast("decimal(18,0)")
    return (
        F.when(F.coalesce(edited, F.lit(False)), F.lit(TOP)).otherwise(F.lit(Decimal(0))).cast("decimal(38,0)")
        + (micros * F.lit(PLACE)).cast("decimal(38,0)")
        + F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)).cast("decimal(38,0)")
    ).cast("decimal(38,0)")


def field_votes(
    rows: DataFrame,
    fields: tuple[str, ...],
    *,
    key: str = "entity_no",
    number: str = "patch_no",
    edited: str = "user_edited",
    at: str = "patched_at",
    half_life_days: float = 180.0,
    as_of: str = "2026-01-01",
) -> DataFrame:
    """(key, field_name, norm, by_user, by_tool, newest_user, newest_tool, top, value, voters, least_no, most_no) for
    each value any row of key offers.

    norm is the value without letter case and surplus white space, null for rows that offer none. by_user and by_tool
    are the sums of UNIT times 0.5 to the power of age in half-lives before as_of (a row without time: as if ten
    half-lives old) over the rows of each source, newest_user and newest_tool the precedence of its newest one, voters
    their number, top the precedence of the best row and value its spelling. Rows without key count for nothing. Partial sums of a key's
    many rows are made before the shuffle.
    """
    own = rows.select(
        F.col(key).alias("_k"), F.col(number).alias("_n"), F.coalesce(edited, F.lit(False)).alias("_e"), F.col(at).cast("timestamp").alias("_t"), *fields
    ).where("_k is not null")
    end = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = F.greatest(F.coalesce((end - F.unix_micros("_t")) / F.lit(86_400e6 * half_life_days), F.lit(10.0)), F.lit(0.0))
    vote = F.floor(F.lit(float(UNIT)) * F.pow(F.lit(0.5), age)).cast("bigint")
    long = own.withColumn("_vote", vote).withColumn("_top", precedence(F.col("_e"), F.col("_t"), F.col("_n"))).select(
        "_k", "_n", "_e", "_vote", "_top",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("_f"),
    ).select("_k", "_n", "_e", "_vote", "_top", "_f.field_name", "_f.value")
    norm = F.when(~no_value(F.col("value")), F.lower(F.trim(F.regexp_replace("value", r"[\s\p{Z}]+", " "))))
    user, tool = F.col("_e"), ~F.col("_e")
    none = F.lit(0).cast("bigint")
    return (
        long.withColumn("norm", norm)
        .groupBy("_k", "field_name", "norm")
        .agg(
            F.sum(F.when(user, F.col("_vote")).otherwise(none)).alias("by_user"),
            F.sum(F.when(tool, F.col("_vote")).otherwise(none)).alias("by_tool"),
            F.max(F.when(user, F.col("_top"))).alias("newest_user"),
            F.max(F.when(tool, F.col("_top"))).alias("newest_tool"),
            F.max("_top").alias("top"),
            F.max_by("value", F.struct("_top", "value")).alias("value"),
            F.count("*").alias("voters"),
            F.min("_n").alias("least_no"),
            F.max("_n").alias("most_no"),
        )
        .withColumnRenamed("_k", key)
    )


def winners(votes: DataFrame, *, key: str = "entity_no", number: str = "patch_no", strict: bool = True, trust: int = 8, values: bool = True) -> DataFrame:
    """(key, field_name, value, number, votes, rivals) of the value with the most votes of each field that has one; without
    values, all but the value itself.

    votes as field_votes() yields them. A user's vote counts trust times one of the extractor; strict: n + 1 times, n
    being the rows that vote on the field, and the newest vote of either source n + 1 times an undecayed one. Equal
    votes: the value with the better row. number is that of the value's best row. rivals: whether key has two or more
    distinct numbers. The values of a key with very many are not brought together.
    """
    has = F.col("h").isNotNull()
    scratch = Scratch(votes.sparkSession)
    votes = votes.withColumn("h", F.when(F.col("norm").isNotNull(), F.xxhash64("norm"))).drop("norm", *[] if values else ["value"])
    votes = scratch.save(votes)
    field = votes.groupBy(key, "field_name").agg(
        F.sum(F.when(has, F.col("voters")).otherwise(0)).cast("decimal(13,0)").alias("n"),
        F.max(F.when(has, F.col("newest_user"))).alias("last_user"),
        F.max(F.when(has, F.col("newest_tool"))).alias("last_tool"),
        F.coalesce(F.min("least_no") != F.max("most_no"), F.lit(False)).alias("rivals"),
        F.count("*").alias("values"),
    ).where("n > 0")
    field = scratch.save(field)
    if strict:
        worth = F.col("n") + F.lit(1).cast("decimal(13,0)")
        newest = lambda mine, last: F.when(F.col(mine) == F.col(last), F.lit(UNIT).cast("decimal(10,0)") * F.col("n")).otherwise(F.lit(0).cast("decimal(10,0)"))
        both = worth * (F.col("by_user") + newest("newest_user", "last_user")) + F.col("by_tool") + newest("newest_tool", "last_tool")
    else:
        both = F.lit(trust).cast("decimal(13,0)") * F.col("by_user") + F.col("by_tool")
    met = lookup(votes.where(has), [key, "field_name"], field, "values", votes.count()).withColumn("votes", both.cast("decimal(38,0)"))
    order = F.struct("votes", "top", "h")
    shown = ["value"] if values else []
    best = met.groupBy(key, "field_name").agg(F.max_by(F.struct(*shown, "top", "votes"), order).alias("w"), F.bool_or("rivals").alias("rivals"))
    best = best.select(key, "field_name", *[f"w.{c}" for c in shown], (F.col("w.top") % F.lit(PLACE)).cast("bigint").alias(number), "w.votes", "rivals")
    return scratch.result(best)


def golden(rows: DataFrame, fields: tuple[str, ...], *, key: str = "entity_no", strict: bool = True, trust: int = 8, **how) -> DataFrame:
    """One record for each key with the winning value of each field; null where no row offers a value."""
    won = winners(field_votes(rows, fields, key=key, **how), key=key, strict=strict, trust=trust)
    ids = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.join(won.groupBy(key).pivot("field_name", list(fields)).agg(F.first("value")), key, "left")
