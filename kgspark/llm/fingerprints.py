"""Records that differ only in white space, letter case, punctuation or field order (problem 2).

Method: every normalised (field name, value) pair is hashed, the hashes of a record are added (a commutative
multiset hash in two lanes of 56 bits) and records are grouped by scope and fingerprint alone. Each record's fields are
then compared with those of its group's first record; groups in which any differ are divided by the fields themselves.
Nothing is sorted, and the copies within one map task are added up before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans.scratch import Scratch
from kgspark.plans.skew import lookup

#: What is neither a letter nor a digit, in Java's notation.
NEITHER = r"[^\p{L}\p{N}]+"
LANE = (1 << 56) - 1


def squash(c: Column) -> Column:
    """Letters and digits only, without letter case (ß equals SS); null becomes the empty string."""
    low = F.lower(F.upper(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), NEITHER, ""))))
    return F.replace(low, F.lit("ß"), F.lit("ss"))


def parsed_pairs(record: Column) -> Column:
    """(key, value) pairs of `key: value | key: value`, `key=value; key=value` or a JSON object of strings."""
    text = F.trim(record)
    json = F.map_entries(F.from_json(text, "map<string,string>"))
    parts = F.filter(F.split(text, r"[|;]"), lambda x: x.rlike("[:=]"))
    plain = F.transform(
        parts,
        lambda x: F.struct(
            F.regexp_extract(x, r"^([^:=]*)[:=]", 1).alias("key"),
            F.regexp_extract(x, r"(?s)^[^:=]*[:=](.*)$", 1).alias("value"),
        ),
    )
    return F.when(text.startswith("{"), F.coalesce(json, plain)).otherwise(plain)


def _first(pairs: Column, field: str) -> Column:
    """The first value of a field; null if there is none."""
    return F.try_element_at(F.filter(pairs, lambda x: squash(x["key"]) == squash(F.lit(field))), F.lit(1))["value"]


def multiset_hash(pairs: Column, lane: int) -> Column:
    """Sum modulo 2^56 of the hashes of (key, value) structs, whatever their order."""
    mask = F.lit(LANE).cast("bigint")
    return F.aggregate(
        pairs,
        F.lit(0).cast("bigint"),
        lambda acc, x: (acc + F.xxhash64(F.lit(lane), x["key"], x["value"]).bitwiseAND(mask)).bitwiseAND(mask),
    )


def fingerprinted(
    rows: DataFrame, *, key: str, scope: str, fields: tuple[str, ...], record: str | None = None
) -> DataFrame:
    """(key, scope, lane_a, lane_b, n_<field>...) of every row.

    A row's fields come from record where that is not null and from the columns of the same names otherwise; in a
    record, keys are compared as values are, other keys are ignored and a repeated key keeps its first value. A
    missing field equals one without letters and digits. A null scope is a scope of its own.
    """
    direct = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in fields])
    pairs = direct if record is None else F.when(F.col(record).isNotNull(), parsed_pairs(F.col(record))).otherwise(direct)
    found = F.transform(pairs, lambda x: F.struct(squash(x["key"]).alias("key"), squash(x["value"]).alias("value")))
    rows = rows.select(F.col(key).alias("_id"), F.coalesce(scope, F.lit("\0")).alias("_scope"), found.alias("_p"))
    own = F.array(
        *[
            F.struct(F.lit(f).alias("key"), F.coalesce(_first(F.col("_p"), f), F.lit("")).alias("value"))
            for f in fields
        ]
    )
    rows = rows.select("_id", "_scope", own.alias("_p"))
    return rows.select(
        "_id",
        "_scope",
        multiset_hash(F.col("_p"), 1).alias("_a"),
        multiset_hash(F.col("_p"), 2).alias("_b"),
        *[F.col("_p")[i]["value"].alias(f"n_{f}") for i, f in enumerate(fields)],
    )


PRINT = ["_scope", "_a", "_b"]


def copy_groups(prints: DataFrame) -> DataFrame:
    """One row for each scope and fingerprint: group_no (least _id) and n_copies."""
    return prints.groupBy(*PRINT).agg(F.min("_id").alias("group_no"), F.count("*").alias("n_copies"))


def verified(scratch: Scratch, prints: DataFrame) -> DataFrame:
    """(_id, group_no, n_copies) of the records that have at least one copy, equal in every field.

    prints: a written table as fingerprinted() makes it, with unique _id."""
    fields = [c for c in prints.columns if c not in ("_id", *PRINT)]
    groups = copy_groups(prints).where("n_copies > 1")
    first = prints.select(F.col("_id").alias("group_no"), *[F.col(c).alias(f"_f{c}") for c in fields])
    groups = scratch.save(first.join(groups.hint("shuffle_hash"), "group_no"))
    same = F.lit(True)
    for c in fields:
        same = same & (F.col(c) == F.col(f"_f{c}"))
    met = lookup(prints, PRINT, groups.withColumn("_n", F.col("n_copies")), "_n", prints.count())
    met = scratch.save(met.select("_id", "group_no", "n_copies", same.alias("same")))
    torn = met.where("not same").select("group_no").distinct()
    if not torn.limit(1).count():
        return met.select("_id", "group_no", "n_copies")
    # fingerprints that unequal records share: these groups are divided by their fields
    torn = scratch.save(torn)
    whole = met.join(torn, "group_no", "left_anti").select("_id", "group_no", "n_copies")
    mixed = scratch.save(prints.join(met.join(torn, "group_no", "left_semi").select("_id"), "_id", "left_semi"))
    parts = mixed.groupBy(*PRINT, *fields).agg(F.min("_id").alias("group_no"), F.count("*").alias("n_copies")).where("n_copies > 1")
    parts = scratch.save(parts).withColumn("_n", F.col("n_copies"))
    divided = lookup(mixed, [*PRINT, *fields], parts, "_n", mixed.count()).select("_id", "group_no", "n_copies")
    return whole.unionByName(divided)


def copies(rows: DataFrame, *, key: str, scope: str, fields: tuple[str, ...], record: str | None = None) -> DataFrame:
    """(key, group_no) of every row that has at least one copy; group_no is the least key among its copies. key is unique."""
    scratch = Scratch(rows.sparkSession)
    prints = scratch.save(fingerprinted(rows, key=key, scope=scope, fields=fields, record=record))
    return scratch.result(verified(scratch, prints).select(F.col("_id").alias(key), "group_no"))


def collapsed(rows: DataFrame, *, key: str, scope: str, fields: tuple[str, ...], record: str | None = None) -> DataFrame:
    """One row for each distinct record: scope, group_no, the fields as its first row spells them, n_copies."""
    scratch = Scratch(rows.sparkSession)
    prints = scratch.save(fingerprinted(rows, key=key, scope=scope, fields=fields, record=record))
    found = scratch.save(verified(scratch, prints))
    firsts = found.where(F.col("_id") == F.col("group_no")).select("group_no", "n_copies")
    alone = prints.select(F.col("_id").alias("group_no")).join(found.select(F.col("_id").alias("group_no")), "group_no", "left_anti")
    groups = firsts.unionByName(alone.select("group_no", F.lit(1).cast("bigint").alias("n_copies")))
    pairs = parsed_pairs(F.col(record)) if record else F.lit(None)
    spelled = [
        F.trim(F.when(F.col(record).isNotNull(), _first(pairs, f)).otherwise(F.col(f)) if record else F.col(f)).alias(f)
        for f in fields
    ]
    first = rows.select(F.col(key).alias("group_no"), F.col(scope).alias(scope), *spelled)
    return scratch.result(groups.join(first, "group_no").select(scope, "group_no", *fields, "n_copies"))
