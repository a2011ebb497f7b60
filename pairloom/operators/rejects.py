"""Rows that fail to parse: delimited records are split into cells, checked by a rule table and set apart with a reason.

Method: cells are exploded into (row, column, value), joined to a rule table, the violations are aggregated to the first
reason of each record, and the valid records are those without a violation (anti-join). All steps are JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import small_side

#: Reasons in the order in which they apply.
REASONS = ("unknown_file", "quoting", "column_count", "invalid_value")

#: White space by Unicode's White_Space property, as a regex class body.
SPACE = "\\t-\\r \\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: The rules of a resume file: column, kind of rule, its pattern and bounds.
RESUME_RULES = [
    ("ID", "pattern", r"\A[A-Za-z0-9_-]{3,}\z", None, None),
    ("Resume_str", "not_blank", None, None, None),
    ("years_experience", "whole_number", r"\A[0-9]+\z", 0, 60),
    ("updated_on", "date", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", None, None),
]
RULE_SCHEMA = "column string, rule string, pattern string, low int, high int"

_ESC, _SEP = "\x01a", "\x01b"


def rule_table(spark: SparkSession, rules: list[tuple] = RESUME_RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def split_cells(text: Column, delim: Column) -> Column:
    """The raw cells of a record. Delimiters between an odd and the next quote are data; an escape keeps any character of the text apart from the separator used."""
    parts = F.split(F.replace(text, F.lit("\x01"), F.lit(_ESC)), '"')
    joined = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, F.replace(s, delim, F.lit(_SEP))).otherwise(s)), '"')
    return F.transform(F.split(joined, _SEP), lambda c: F.replace(c, F.lit(_ESC), F.lit("\x01")))


def badly_quoted(cell: Column) -> Column:
    """Whether a quote stands anywhere but around the whole cell or doubled inside."""
    inner = F.substring(cell, F.lit(2), F.greatest(F.length(cell) - 2, F.lit(0)))
    whole = (F.length(cell) >= 2) & F.startswith(cell, F.lit('"')) & F.endswith(cell, F.lit('"'))
    return F.contains(cell, F.lit('"')) & ~(whole & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"')))


def unquote(cell: Column) -> Column:
    return F.when(F.startswith(cell, F.lit('"')), F.replace(F.substring(cell, F.lit(2), F.greatest(F.length(cell) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(cell)


def parsed(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Records with their cells: rec_id, file_id, key (digest of the text, so that repeated rec_ids with other texts stay apart), cells, names."""
    heads = files.select("file_id", "delim", F.split(F.col("header_text"), F.concat(F.lit("\\Q"), F.col("delim"), F.lit("\\E"))).alias("names")).dropDuplicates(["file_id"])
    rows = raw.select("rec_id", "file_id", "rec_text", F.sha2(F.coalesce("rec_text", F.lit("")), 256).alias("key")).join(small_side(heads), "file_id", "left")
    return rows.withColumn("cells", F.when(F.col("rec_text").isNotNull(), split_cells(F.col("rec_text"), F.col("delim")))).drop("rec_text")


def violation(value: Column) -> Column:
    """Whether a value breaks the rule in the columns rule, pattern, low and high."""
    empty = value == ""
    return (
        F.when(F.col("rule") == "pattern", ~F.regexp_like(value, F.col("pattern")))
        .when(F.col("rule") == "not_blank", F.regexp_like(value, F.lit(rf"\A[{SPACE}]*\z")))
        .when(F.col("rule") == "whole_number", ~empty & ~(F.regexp_like(value, F.col("pattern")) & F.coalesce(F.expr("try_cast(value AS decimal(38,0))").between(F.col("low"), F.col("high")), F.lit(False))))
        .when(F.col("rule") == "date", ~empty & ~(F.regexp_like(value, F.col("pattern")) & F.expr("try_to_date(value, 'yyyy-MM-dd')").isNotNull()))
        .otherwise(F.lit(False))
    )


def errors(raw: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per distinct record that cannot be loaded: rec_id, file_id, key, reason, detail (the columns concerned).

    Null record text counts as a record without fields (column_count); a file_id without a header is unknown_file. Header
    names without a rule are free. Extra columns of either table are ignored. Empty tables give an empty result.
    """
    rows = parsed(raw, files)
    shape = rows.select("rec_id", "file_id", "key", F.when(F.col("names").isNull(), 0).when(F.exists(F.coalesce("cells", F.array()), badly_quoted), 1).when(F.coalesce(F.size("cells"), F.lit(-1)) != F.size("names"), 2).alias("level"), F.lit("").alias("column")).where("level IS NOT NULL")
    cells = (
        rows.where(F.size("cells") == F.size("names"))
        .select("rec_id", "file_id", "key", F.col("names"), F.posexplode("cells").alias("pos", "raw"))
        .select("rec_id", "file_id", "key", F.element_at("names", F.col("pos") + 1).alias("column"), unquote(F.col("raw")).alias("value"))
    )
    broken = cells.join(small_side(rules), "column").where(violation(F.col("value"))).select("rec_id", "file_id", "key", F.lit(3).alias("level"), "column")
    return shape.unionByName(broken).groupBy("rec_id", "file_id", "key").agg(F.min("level").alias("level"), F.array_join(F.array_sort(F.collect_set(F.struct("level", "column"))["column"]), ",").alias("detail")).select("rec_id", "file_id", "key", F.element_at(F.array(*map(F.lit, REASONS)), F.col("level") + 1).alias("reason"), "detail")


def valid_rows(raw: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """The loadable records as typed columns; a column that a file lacks is null, an empty number or date too. Records repeated in full stay repeated."""
    bad = errors(raw, files, rules).select("rec_id", "file_id", "key")
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("rec_id", "file_id", "key")]
    good = parsed(raw, files).alias("g").join(bad.alias("b"), on, "left_anti")
    value = lambda c: unquote(F.get("cells", (F.array_position("names", c) - 1).cast("int")))
    return good.select(
        "rec_id",
        "file_id",
        value("ID").alias("ID"),
        value("Resume_str").alias("Resume_str"),
        F.nullif(value("Category"), F.lit("")).alias("Category"),
        F.nullif(value("Gender"), F.lit("")).alias("Gender"),
        F.nullif(value("years_experience"), F.lit("")).cast("int").alias("years_experience"),
        F.to_date(F.nullif(value("updated_on"), F.lit(""))).alias("updated_on"),
    )
