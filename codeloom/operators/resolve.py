"""What imports, calls and tests refer to, as joins over the files' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.schema import file_id, symbol_id
from codeloom.sources.files import is_test_path


def _first_known(rows: DataFrame, keys: list[str], candidates: str, known: DataFrame, out: str) -> DataFrame:
    """``keys`` and ``out``, the first of ``candidates`` that is a known path."""
    return (
        rows.select(*keys, F.posexplode(candidates).alias("_pos", "_path"))
        .join(known.select(F.col("path").alias("_path")), "_path")
        .groupBy(*keys)
        .agg(F.min_by("_path", "_pos").alias(out))
    )


def imports(records: DataFrame, known: DataFrame) -> DataFrame:
    """(path, seq, raw, dst, neighbor) of each import that means a file or a package."""
    rows = records.select("path", F.posexplode("imports").alias("seq", "i")).select("path", "seq", "i.*")
    found = _first_known(rows, ["path", "seq"], "candidates", known, "target")
    stem = F.regexp_extract(F.col("target"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return (
        rows.join(found, ["path", "seq"], "left")
        .where("target is not null or package is not null")
        .select(
            "path", "seq", "raw",
            F.coalesce(file_id(F.col("target")), F.concat(F.lit("package:"), "package")).alias("dst"),
            F.coalesce(stem, "package").alias("neighbor"),
        )
    )


def bindings(records: DataFrame, known: DataFrame) -> DataFrame:
    """(path, bound, imported, module_path, sub_path) of the names that a file's imports bind."""
    rows = records.select("path", F.explode("bindings").alias("b")).select("path", F.col("b.name").alias("bound"), "b.imported", "b.module_candidates", "b.sub_candidates")
    keys = ["path", "bound"]
    rows = rows.join(_first_known(rows, keys, "module_candidates", known, "module_path"), keys, "left")
    rows = rows.join(_first_known(rows, keys, "sub_candidates", known, "sub_path"), keys, "left")
    return rows.select(*keys, "imported", "module_path", "sub_path")


def is_vendor_symbol(node_id: Column) -> Column:
    return node_id.rlike(r":(\.venv|venv|vendor|node_modules)/")


def unique_names(symbols: DataFrame) -> DataFrame:
    """(name, unique_id): the one project symbol of a name, else the one symbol at all. ``symbols`` has a
    row per definition, so a name defined twice in one file is no longer unique."""
    vendor = is_vendor_symbol(F.col("id"))
    counts = symbols.groupBy("name").agg(
        F.count(F.when(~vendor, 1)).alias("own"), F.min(F.when(~vendor, F.col("id"))).alias("own_id"), F.count("*").alias("all"), F.min("id").alias("all_id")
    )
    return counts.select("name", F.when(F.col("own") == 1, F.col("own_id")).when(F.col("all") == 1, F.col("all_id")).alias("unique_id")).where("unique_id is not null")


def calls(records: DataFrame, known: DataFrame) -> DataFrame:
    """(path, seq, src, dst, name, qualifier, line) of each call whose target is certain.

    A qualified call needs its qualifier bound by an import: to a submodule that defines the name, else to
    the module's symbol. A bare call means a definition of its own file, else what an import binds the name
    to (and nothing if that fails), else the only definition of the name anywhere.
    """
    symbols = records.select("path", F.explode("symbols").alias("s")).select("path", "s.name").withColumn("id", symbol_id(F.col("path"), F.col("name")))
    defined = symbols.distinct()
    rows = records.select("path", F.posexplode("calls").alias("seq", "c")).select("path", "seq", "c.*").withColumn("bound", F.coalesce("qualifier", "name"))
    rows = rows.join(bindings(records, known).withColumn("is_bound", F.lit(True)), ["path", "bound"], "left")
    qualified, bound = F.col("qualifier").isNotNull(), F.coalesce("is_bound", F.lit(False))

    def look_up(df: DataFrame, path: Column, name: Column, out: str) -> DataFrame:
        table = defined.select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("id").alias(out))
        return df.join(table, (path == F.col("_p")) & (name == F.col("_n")), "left").drop("_p", "_n")

    rows = look_up(rows, F.when(qualified, F.when(F.col("imported").isNotNull(), F.col("sub_path"))).otherwise(F.col("path")), F.col("name"), "first_id")
    rows = look_up(rows, F.when(bound, F.col("module_path")), F.when(qualified, F.coalesce("imported", "name")).otherwise(F.col("imported")), "second_id")
    rows = look_up(rows, F.col("path"), F.col("scope"), "scope_id")
    rows = rows.join(unique_names(symbols), "name", "left")
    target = F.when(qualified, F.when(bound, F.coalesce("first_id", "second_id"))).otherwise(F.coalesce("first_id", F.when(bound, F.col("second_id")).otherwise(F.col("unique_id"))))
    out = rows.select("path", "seq", F.coalesce("scope_id", file_id(F.col("path"))).alias("src"), target.alias("dst"), "name", "qualifier", "line")
    return out.where("dst is not null and src <> dst")


def stem(path: Column) -> Column:
    """A file's name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def tests(known: DataFrame) -> DataFrame:
    """(src, dst) of test files and the files whose stem their name has, its test marks taken off."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.test|\.spec|_test", ""), r"^test_", "")
    sources = known.select(F.col("path").alias("target"), stem(F.col("path")).alias("stem"))
    marked = known.where(is_test_path(F.col("path"))).select("path", stem(base).alias("stem"))
    return marked.join(sources, "stem").where("path <> target").select(file_id(F.col("path")).alias("src"), file_id(F.col("target")).alias("dst"))


def last_seen(symbols: DataFrame, timeline: DataFrame) -> DataFrame:
    """As-of by line: each row of ``timeline`` (path, line) with the last symbol (path, line, name) that
    starts at or before it, as one ordered pass per path."""
    from pyspark.sql import Window

    both = symbols.select("path", "line", F.lit(0).alias("late"), "name", F.lit(None).cast("long").alias("row")).unionByName(
        timeline.select("path", "line", F.lit(1).alias("late"), F.lit(None).cast("string").alias("name"), "row")
    )
    upto = Window.partitionBy("path").orderBy("line", "late", "name").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("scope", F.last("name", ignorenulls=True).over(upto)).where("late = 1").select("path", "line", "row", "scope")
