"""Interval, symbol, rename and report text as DataFrames, and back.

Files are read whole lines at a time with their path; the order of lines inside a
file matters, so each line carries its number, taken from one split a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed formats of the three text files.
RANGE = r"^\s*#?\s*(\S+)\s+start:0x([0-9A-Fa-f]+)\s+end:0x([0-9A-Fa-f]+)(.*)$"
SYMBOL = r"^(\S+) = (\S+):0x([0-9A-Fa-f]+); // (.*)$"
RENAME = r"^\s*(\S+)\s*=\s*(\S+)(\s+local)?\s*$"
CODE = (".text", ".init")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of every line of each file, numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return number_lines(whole, "path", "value")


def number_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("n", "line"))


def intervals(rows: DataFrame, key: str = "path", confident: bool = False) -> DataFrame:
    """(key, unit, section, start, end, attributes, suffix, unit_ord, entry_ord, candidate) of interval text.

    Attributes are a sorted set, to compare; the suffix has them as written, to render.

    A unit's name ends in a colon at the start of a line; its ranges follow, indented.
    Lines that start with # are candidates, and left out if only confident ones are asked
    for.  Everything before the first unit but a header named Sections is ignored."""
    head = F.regexp_extract("line", r"^#?\s?([^\s#].*):\s*$", 1)
    marked = rows.withColumn("__unit", F.when(head != "", head)).withColumn("__n", F.when(head != "", F.col("n")))
    line = Window.partitionBy(key).orderBy("n")
    marked = marked.withColumn("unit", F.last("__unit", True).over(line)).withColumn("unit_ord", F.last("__n", True).over(line))
    part = lambda i: F.regexp_extract("line", RANGE, i)
    found = marked.where(F.col("__unit").isNull() & F.col("unit").isNotNull() & (F.col("unit") != "Sections") & F.col("line").rlike(RANGE))
    number = lambda i: F.conv(part(i), 16, 10).cast("long")
    rest = F.trim(F.regexp_replace(part(4), r"#.*$", ""))
    attributes = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(rest, r"\s+"))))
    out = found.select(
        key, "unit", part(1).alias("section"), number(2).alias("start"), number(3).alias("end"), attributes.alias("attributes"),
        rest.alias("suffix"), "unit_ord", F.col("n").alias("entry_ord"), F.col("line").rlike(r"^\s*#").alias("candidate"),
    )
    return out.where("not candidate") if confident else out


def _cleaned(line: Column) -> Column:
    """A line of a proposal as it would stand in the file: without its leading # and its candidate note."""
    return F.regexp_replace(F.regexp_replace(line, "^#", ""), "  # candidate:.*$", "")


def headers(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, header, end): everything up to and with the first blank line, and that line's number."""
    blank = rows.where(F.trim("line") == "").groupBy(key).agg(F.min("n").alias("end"))
    upper = rows.join(blank, key).where("n <= end").groupBy(key, "end")
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return upper.agg(F.concat(F.array_join(lines_, "\n"), F.lit("\n")).alias("header")).select(key, "header", "end")


def bodies(rows: DataFrame, key: str = "path", raw: bool = False) -> DataFrame:
    """(key, unit, unit_ord, entry_ord, line): the entries of each unit behind the header, in file order.

    Lines of proposals are uncommented, or with ``raw`` kept as they are written."""
    upper = headers(rows, key).select(key, "end")
    rows = rows.join(upper, key, "left").where("n > coalesce(end, -1)").withColumn("__clean", _cleaned(F.col("line")))
    name = F.regexp_extract("__clean", r"^(\S.*):\s*$", 1)
    line = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumn("__unit", F.when(name != "", name)).withColumn("__n", F.when(name != "", F.col("n")))
    rows = rows.withColumns({"unit": F.last("__unit", True).over(line), "unit_ord": F.last("__n", True).over(line)})
    kept = rows.where(F.col("__unit").isNull() & F.col("unit").isNotNull() & (F.trim("line") != ""))
    return kept.select(key, "unit", "unit_ord", F.col("n").alias("entry_ord"), (F.col("line") if raw else F.col("__clean")).alias("line"))


def listed_twice(entries: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit) of units that a file lists more than once, which it must not."""
    return entries.groupBy(key, "unit").agg(F.count_distinct("unit_ord").alias("n")).where("n > 1").select(key, "unit")


def rendered(header: DataFrame, entries: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): the file again, byte for byte, from its header and entries (in unit_ord, entry_ord)."""
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("entry_ord", "line"))), lambda x: x["line"])
    block = F.concat("unit", F.lit(":\n"), F.array_join(lines_, "\n"), F.lit("\n\n"))
    blocks = entries.groupBy(key, "unit", "unit_ord").agg(block.alias("block"))
    text = blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "block"))), lambda x: x["block"]), "").alias("body"))
    whole = header.join(text, key, "left").select(key, F.concat("header", F.coalesce("body", F.lit(""))).alias("text"))
    return whole.select(key, F.regexp_replace("text", r"\n\n+\z", "\n").alias("text"))


def placed_units(units: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, place): the order of units after new ones are inserted.

    units: (key, unit, unit_ord, start, new); start is a unit's first code address, or null.
    Old units keep their order.  A new unit with code goes before the first old one that starts
    behind it, or to the end; new units of one place go by start and name; those without code last."""
    low = -F.col("start")
    behind = Window.partitionBy(key).orderBy(low).rangeBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(~F.col("new") & F.col("start").isNotNull(), F.col("unit_ord"))).over(behind)
    rows = units.withColumn("anchor", F.when(F.col("start").isNotNull(), first))
    never = F.lit(1 << 62)
    at = F.when(~F.col("new"), F.col("unit_ord")).otherwise(F.coalesce("anchor", never))
    kind = F.when(F.col("new") & F.col("start").isNull(), 2).when(F.col("new"), 0).otherwise(1)
    order = Window.partitionBy(key).orderBy(at, kind, F.when(F.col("new"), F.col("start")), "unit")
    return rows.select(key, "unit", (F.row_number().over(order) - 1).alias("place"))


def without_misaligned(entries: DataFrame, reason: str = "alignment") -> DataFrame:
    """Raw entries but those whose note says that they are misaligned."""
    return entries.where(~F.col("line").contains(reason))


def render_intervals(ranges: DataFrame) -> DataFrame:
    """(unit, text) blocks of (unit, section, start, end[, suffix]), by section and start; order blocks by ``first``."""
    entry = F.format_string("\t%-11s start:0x%08X end:0x%08X", "section", "start", "end")
    if "suffix" in ranges.columns:
        entry = F.concat(entry, F.when(F.coalesce("suffix", F.lit("")) != "", F.concat(F.lit(" "), "suffix")).otherwise(""))
    row = F.struct("section", "start", entry.alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n")
    blocks = ranges.groupBy("unit").agg(body.alias("body"), F.min(F.when(F.col("section").isin(*CODE), F.col("start"))).alias("first"))
    return blocks.select("unit", F.concat("unit", F.lit(":\n"), "body", F.lit("\n")).alias("text"), "first")


def symbols(rows: DataFrame) -> DataFrame:
    """(name, section, address, kind, size, local) of symbol lines; other lines are skipped."""
    part = lambda i: F.regexp_extract("line", SYMBOL, i)
    field = lambda f: F.regexp_extract(part(4), f"(?:^| ){f}:(\\S+)", 1)
    size = F.regexp_extract(part(4), r"(?:^| )size:0x([0-9A-Fa-f]+)", 1)
    return rows.where(F.col("line").rlike(SYMBOL)).select(
        part(1).alias("name"), part(2).alias("section"), F.conv(part(3), 16, 10).cast("long").alias("address"),
        F.nullif(field("type"), F.lit("")).alias("kind"), F.when(size != "", F.conv(size, 16, 10).cast("long")).alias("size"),
        (field("scope") == "local").alias("local"),
    )


def renames(rows: DataFrame) -> DataFrame:
    """(old, new, local) of rename lines; comments and other lines are skipped."""
    part = lambda i: F.regexp_extract("line", RENAME, i)
    good = rows.where(~F.col("line").rlike(r"^\s*#") & F.col("line").rlike(RENAME))
    return good.select(part(1).alias("old"), part(2).alias("new"), (part(3) != "").alias("local"))


def apply_renames(table: DataFrame, plan: DataFrame) -> DataFrame:
    """symbols (name, ...) with the new names of plan (old, new, local).

    A global rename onto a name that stays is a collision and is not applied; swaps and
    chains work since only names that stay count.  Adds ``was`` for renamed rows."""
    stays = table.select("name").distinct().join(plan.select(F.col("old").alias("name")), "name", "left_anti")
    clash = plan.join(stays.select(F.col("name").alias("new"), F.lit(True).alias("taken")), "new", "left")
    good = clash.where("local or taken is null").select("old", "new")
    out = table.join(good, table["name"] == good["old"], "left")
    return out.select(F.coalesce("new", "name").alias("name"), *(c for c in table.columns if c != "name"), F.col("old").alias("was"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """(unit, section, percent, size) of a build report in JSON; numbers may be strings; zstd by extension."""
    schema = "units array<struct<name: string, sections: array<struct<name: string, size: string, fuzzy_match_percent: string>>>>"
    units = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("units").alias("u"))
    rows = units.select(F.col("u.name").alias("unit"), F.explode_outer("u.sections").alias("s"))
    number = lambda c, t: F.expr(f"try_cast({c} as {t})")
    return rows.select("unit", F.col("s.name").alias("section"), number("s.fuzzy_match_percent", "double").alias("percent"), number("s.size", "long").alias("size"))


def add_missing(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Intervals of existing units, and of proposed units that do not exist yet."""
    new = proposed.join(existing.select("unit").distinct(), "unit", "left_anti")
    return existing.unionByName(new.select(*existing.columns))
