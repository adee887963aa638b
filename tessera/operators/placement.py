"""Copies of one compiled body told apart by what they refer to.

Several objects may hold the same body, and the target as many occurrences of it.  An
occurrence belongs to the copy whose references agree with it site by site: equal offset,
kind and addend, and endpoints of equal body that refer alike themselves.  At least one
endpoint must be found nowhere else.  A family is placed as a whole or not at all: every
copy agrees with exactly one occurrence, and no two with the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families of more copies are left open.
MOST = 16
_PLACE = ("unit", "section", "address")


def _listed(sites: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, sites, signature): a function's references in order, and their offset, kind and addend."""
    every = F.sort_array(F.collect_list(F.struct("n", "offset", "kind", "addend", "to_section", "to_address")))
    plain = F.transform("sites", lambda x: F.concat_ws(",", x["offset"], x["kind"], x["addend"]))
    return sites.groupBy(*keys).agg(every.alias("sites")).select(*keys, "sites", F.array_join(plain, ";").alias("signature"))


def _opened(listed: DataFrame, keys: list[str]) -> DataFrame:
    return listed.select(*keys, F.explode("sites").alias("s")).select(*keys, "s.*")


def families(definitions: DataFrame, functions: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(section, body, copies): bodies with as many clean named copies as places in objects and occurrences in the target."""
    keys = ["section", "body"]
    named = definitions.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.bool_and("clean").alias("clean"))
    places = functions.where("body is not null").groupBy(*keys).agg(F.count_distinct("unit", "address").alias("places"))
    seen = targets.where("body is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"))
    rows = named.join(places, keys).join(seen, keys)
    return rows.where(F.col("copies").between(2, most) & (F.col("copies") == F.col("places")) & (F.col("copies") == F.col("seen")) & F.col("clean")).select(*keys, "copies")


def _tokens(rows: DataFrame, keys: list[str], *kept: str) -> DataFrame:
    """(keys, token, sites) of functions all of whose endpoints have a body; sites keep n, offset, e_body and what is named."""
    site = F.struct("n", "offset", "kind", "addend", "e_body", "e_signature", *kept)
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(site)).alias("sites"), F.bool_and(F.col("e_body").isNotNull()).alias("whole"))
    plain = F.transform("sites", lambda x: F.concat_ws(",", x["offset"], x["kind"], x["addend"], x["e_body"], x["e_signature"]))
    held = F.transform("sites", lambda x: F.struct(*(x[c].alias(c) for c in ("n", "offset", "e_body", *kept))))
    return out.where("whole").select(*keys, F.unhex(F.sha2(F.array_join(plain, "\n"), 256)).alias("token"), held.alias("sites"))


def placements(
    definitions: DataFrame,
    functions: DataFrame,
    sites: DataFrame,
    targets: DataFrame,
    target_sites: DataFrame,
    known: DataFrame,
    identified: DataFrame,
) -> DataFrame:
    """(unit, section, address, target_address, offset, endpoint, competitors) of every family that its references place.

    definitions: (unit, section, address, body, clean), the named copies; functions: (unit, section,
    address, body), all compiled ones; targets: (section, address, body); sites: (place, n, offset,
    kind, addend, to_section, to_address), the place being (unit, section, address) or (section,
    address); known: (section, address) of the target functions whose references were read;
    identified: (unit, section, address, body) of target functions known to be the unit's.
    offset and endpoint name the first endpoint found nowhere else; competitors lists unit and
    target_address of the family's other copies."""
    family = families(definitions, functions, targets)
    one = functions.where("body is not null").groupBy(*_PLACE).agg(F.min("body").alias("e_body"), F.max("body").alias("other")).where("e_body = other")
    listed = _listed(sites, _PLACE)
    ends = one.join(listed.drop("sites"), list(_PLACE), "left").select("unit", F.col("section").alias("to_section"), F.col("address").alias("to_address"), "e_body", F.coalesce("signature", F.lit("")).alias("e_signature"))
    copies = definitions.join(family, ["section", "body"])
    mine = _opened(listed.join(copies.select(*_PLACE, "body"), list(_PLACE)), [*_PLACE, "body"])
    mine = _tokens(mine.join(ends, ["unit", "to_section", "to_address"], "left"), [*_PLACE, "body"]).drop("sites")

    read = known.select("section", "address", F.lit(True).alias("known")).distinct()
    seen = _listed(target_sites, ("section", "address"))
    theirs = targets.join(read, ["section", "address"], "left").join(seen.drop("sites"), ["section", "address"], "left")
    theirs = theirs.select(F.col("section").alias("to_section"), F.col("address").alias("to_address"), F.col("body").alias("e_body"), F.coalesce("known", F.lit(False)).alias("known"), F.when(F.col("known"), F.col("signature")).alias("signature"))
    theirs = theirs.withColumn("e_signature", F.coalesce("signature", F.lit(""))).drop("signature")
    places = targets.join(family, ["section", "body"]).join(read.drop("known"), ["section", "address"])
    there = _opened(seen.join(places.select("section", "address", "body"), ["section", "address"]), ["section", "address", "body"])
    there = _tokens(there.join(theirs, ["to_section", "to_address"], "left"), ["section", "address", "body"], "to_section", "to_address", "known").withColumnRenamed("address", "target_address")

    pairs = mine.join(there, ["section", "body", "token"])
    at = pairs.select(*_PLACE, "body", "target_address", F.explode("sites").alias("s")).select(*_PLACE, "body", "target_address", "s.*")
    lone = functions.where("body is not null").groupBy("body").agg(F.count_distinct(*_PLACE).alias("n")).where("n = 1").select(F.col("body").alias("e_body"))
    lone = lone.join(targets.groupBy("body").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("body").alias("e_body")), "e_body")
    sure = identified.select("unit", F.col("section").alias("to_section"), F.col("address").alias("to_address"), F.col("body").alias("e_body"), F.lit(True).alias("sure")).distinct()
    at = at.join(lone, "e_body").join(sure, ["unit", "to_section", "to_address", "e_body"], "left").where("known or sure")
    found = at.groupBy(*_PLACE, "body", "target_address").agg(F.min(F.struct("n", "offset", "e_body")).alias("first"))

    single = found.groupBy(*_PLACE, "body").agg(F.count(F.lit(1)).alias("n"), F.min("target_address").alias("target_address"), F.min("first").alias("first")).where("n = 1")
    placed = single.groupBy("section", "body").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("target_address").alias("distinct"), F.sort_array(F.collect_list(F.struct("unit", "address", "target_address", "first"))).alias("all")
    )
    placed = placed.join(family, ["section", "body"]).where("n = copies and distinct = copies")
    rows = placed.select("section", "all", F.explode("all").alias("x"))
    others = F.filter("all", lambda y: ~((y["unit"] == F.col("x.unit")) & (y["address"] == F.col("x.address"))))
    return rows.select(
        "x.unit", "section", "x.address", "x.target_address", F.col("x.first.offset").alias("offset"), F.col("x.first.e_body").alias("endpoint"),
        F.array_join(F.transform(others, lambda y: F.concat_ws(":", y["unit"], y["target_address"])), ",").alias("competitors"),
    )
