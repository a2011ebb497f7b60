"""Delimited text files: dialects, splittable reading with rejects, rankings, skills, and sinks.

Files are read as lines by spark.read.text, so they split at any line and lie on any file system. Quoted fields may hold
line breaks: each line maps the state `within quotes or not` at its start to the state at its end, these maps are composed
over the lines of a block by windows and over the blocks of a file by a small table, and lines that end within quotes are
joined to the next. No step needs a whole file in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.session import small_side

BOM = "﻿"
#: Delimiters that are tried, the likeliest first.
DELIMITERS = (",", "\t", ";", "|")
#: Lines that tell the dialect of a file.
SAMPLE_LINES = 50


def _first_lines(spark: SparkSession, path: str) -> list[str]:
    return [r[0].rstrip("\r") for r in spark.read.text(path, lineSep="\n").select("value").head(SAMPLE_LINES)]


def detect(lines: Sequence[str]) -> tuple[str, bool]:
    """(delimiter, whether the first line is a `sep=` hint) from a file's first lines; comma if nothing can be told.

    Of the delimiters that stand equally often in all complete records, outside quotes, the one that stands most often wins;
    if none does so, the one most often in the first record.
    """
    if not lines:
        return ",", False
    first = lines[0].lstrip(BOM)
    if re.match(r"(?i)sep=.", first):
        hint = first[4:].strip(" ") or first[4]
        return "\t" if hint.startswith("\\t") else hint[0], True
    records, open_ = [], ""
    for line in lines:
        open_ += line + "\n"
        if open_.count('"') % 2 == 0:
            if open_.strip():
                records.append(re.sub(r'"[^"]*"', "", open_))
            open_ = ""
    if not records:
        return ",", False
    counts = {d: [r.count(d) for r in records] for d in DELIMITERS}
    steady = [d for d in DELIMITERS if counts[d][0] and len(set(counts[d])) == 1]
    return max(steady or DELIMITERS, key=lambda d: (counts[d][0], -DELIMITERS.index(d))) if any(counts[d][0] for d in DELIMITERS) else ",", False


def _patterns(sep: str) -> tuple[str, str, str, str]:
    """Regexes over a line or record: it ends within quotes if begun outside, or if begun within; one field with its delimiter before; a whole well-formed field."""
    d = re.escape(sep)
    shut = r'"[^"]*+(?:""[^"]*+)*+"'
    fields = rf'(?:(?:{shut}[^{d}]*+|(?!")[^{d}]*+){d})*+'
    unclosed = r'"[^"]*+(?:""[^"]*+)*+\z'
    return rf"\A{fields}{unclosed}", rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"(?!")[^{d}]*+{d}{fields}{unclosed})', rf"{d}({shut}[^{d}]*+|[^{d}]*+)", rf"(?s)\A(?:{shut}|[^{d}\"]*+|[^\"].*)\z"


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, row_index, record, unclosed): the records of one or more files, row_index from 0 within each file; of an unclosed one the first line only."""
    outside, within, _, _ = _patterns(sep)
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    v = F.regexp_replace("value", f"^{BOM}", "")
    lines = lines.withColumn("value", F.when((F.col("block") == 0), v).otherwise(F.col("value"))).withColumns({"o": F.col("value").rlike(outside).cast("int"), "i": F.col("value").rlike(within).cast("int")})
    # a line fixes the state, keeps it, or turns it; the state after a line is the last fixed one, turned as often since
    w = W.partitionBy("file", "block").orderBy("at")
    fixed = F.when(F.col("o") == F.col("i"), F.col("o"))
    lines = lines.withColumn("turns", F.sum(F.when((F.col("o") == 1) & (F.col("i") == 0), 1).otherwise(0)).over(w))
    lines = lines.withColumn("last", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("s"), "turns")), ignorenulls=True).over(w))
    state = lambda start: F.when(F.col("last").isNotNull(), F.pmod(F.col("last.s") + F.col("turns") - F.col("last.turns"), F.lit(2))).otherwise(F.pmod(start + F.col("turns"), F.lit(2)))
    lines = lines.withColumns({"after0": state(F.lit(0)), "after1": state(F.lit(1))})
    ends = lines.groupBy("file", "block").agg(F.max_by("after0", "at").alias("e0"), F.max_by("after1", "at").alias("e1"), F.sum(1 - F.col("after0")).alias("n0"), F.sum(1 - F.col("after1")).alias("n1"))
    # one row per block: the state at its start and the records before it
    per_file = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "e0", "e1", "n0", "n1"))).alias("bs"))
    step = lambda acc, b: F.struct(F.when(acc["s"] == 0, b["e0"]).otherwise(b["e1"]).cast("int").alias("s"), (acc["n"] + F.when(acc["s"] == 0, b["n0"]).otherwise(b["n1"])).alias("n"), F.concat(acc["out"], F.array(F.struct(b["block"].alias("block"), acc["s"].alias("s"), acc["n"].alias("n")))).alias("out"))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<block:bigint,s:int,n:bigint>>").alias("out"))
    run = per_file.select("file", F.aggregate("bs", start, step).alias("r")).select("file", F.inline("r.out"), F.when(F.col("r.s") == 1, F.col("r.n")).alias("open_index"))
    starts = run.select("file", "block", F.col("s"), F.col("n"), "open_index")
    j = lines.join(small_side(starts), ["file", "block"]).withColumn("after", F.when(F.col("s") == 0, F.col("after0")).otherwise(F.col("after1")))
    # a record ends with every line that ends outside quotes
    ended = F.coalesce(F.sum(1 - F.col("after")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    j = j.withColumn("row_index", F.col("n") + ended).withColumn("unclosed", F.coalesce(F.col("row_index") == F.col("open_index"), F.lit(False)))
    whole = j.where("NOT unclosed").groupBy("file", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("record"))
    # a quotation that is never closed runs to the end of its file: its first line tells enough, the rest is not gathered
    open_ = j.where("unclosed").groupBy("file", "row_index").agg(F.min_by("value", F.struct("block", "at")).alias("record"))
    both = whole.withColumn("unclosed", F.lit(False)).unionByName(open_.withColumn("unclosed", F.lit(True)))
    return both.select("file", "row_index", F.regexp_replace("record", r"\r\z", "").alias("record"), "unclosed")


def cells(record: Column, sep: str) -> Column:
    """The fields of a record, unquoted; text after a closing quote is kept."""
    raw = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(_patterns(sep)[2]), F.lit(1))
    end = lambda c: F.regexp_extract(c, r'\A("[^"]*+(?:""[^"]*+)*+")', 1)
    plain = lambda c: F.concat(F.replace(F.substring(end(c), F.lit(2), F.greatest(F.length(end(c)) - 2, F.lit(0))), F.lit('""'), F.lit('"')), F.substring(c, F.length(end(c)) + 1, F.length(c)))
    return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')) & (F.length(end(c)) > 1), plain(c)).otherwise(c))


def parse_header(line: str, sep: str) -> list[str]:
    """Column names: unquoted, without byte-order mark and surrounding blanks; repeated names are numbered from 2."""
    names = [re.sub('""', '"', m[1]) if m[1] is not None else m[2] for m in re.finditer(rf'(?:\A|{re.escape(sep)})(?:"((?:[^"]|"")*)"|([^{re.escape(sep)}]*))', line)]
    out: list[str] = []
    for c in (n.lstrip(BOM).strip() for n in names):
        k = 2
        while (c if k == 2 else f"{c}_{k - 1}") in out:
            k += 1
        out.append(c if k == 2 else f"{c}_{k - 1}")
    return out


def header(spark: SparkSession, path: str, sep: str | None = None) -> tuple[list[str], str, bool]:
    """(names, delimiter, hint) of a file; a header record may span lines."""
    lines = _first_lines(spark, path)
    found, hint = detect(lines)
    rest, text = lines[int(hint) :], ""
    for line in rest:
        text += ("\n" if text else "") + line
        if text.count('"') % 2 == 0:
            break
    return (parse_header(text.lstrip(BOM), sep or found) if text.strip(BOM + " ") else []), sep or found, hint


def read_with_rejects(spark: SparkSession, path: str, sep: str | None = None, key: str | None = None, surplus: str = "_surplus", index: str = "_row_index") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): all columns as text with their row index within the file, counted from 0 after the header.

    Missing cells are empty text, surplus cells are kept in an array. Only the first record of each file is its header, so
    rows that repeat it stay. A record whose quotation is never closed goes to the rejects (which, row_index, id_if_any,
    reason), as does a file that cannot be read (row_index -1). Blank lines are no records.
    """
    none = "which string, row_index long, id_if_any string, reason string"
    try:
        names, sep, hint = header(spark, path, sep)
    except Exception as e:  # noqa: BLE001 - whatever the file system says becomes the reason
        return spark.createDataFrame([], "id string"), spark.createDataFrame([(path.rstrip("/").rsplit("/", 1)[-1], -1, "", "unreadable: " + str(e).split("\n")[0][:200])], none)
    if not names:
        return spark.createDataFrame([], "id string"), spark.createDataFrame([], none)
    skip = int(hint) + 1
    all_ = records(spark, path, sep).where(F.col("row_index") >= skip).withColumn("row_index", F.col("row_index") - skip).where("record <> ''").withColumn("c", cells(F.col("record"), sep))
    value = lambda n: F.coalesce(F.get("c", F.lit(n)), F.lit(""))
    rows = all_.where("NOT unclosed").select(F.col("row_index").alias(index), *[value(n).alias(c) for n, c in enumerate(names)], F.slice("c", len(names) + 1, 1 << 30).alias(surplus))
    at = names.index(key) if key in names else 0
    which = F.element_at(F.split("file", "/"), -1)
    return rows, all_.where("unclosed").select(which.alias("which"), "row_index", F.substring(value(at), 1, 120).alias("id_if_any"), F.lit("unclosed quote").alias("reason"))


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """The rows of read_with_rejects without row index and surplus cells."""
    return read_with_rejects(spark, path, sep)[0].drop("_row_index", "_surplus")


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, resume_id, score, rank, source) with ranks and scores parsed; rows without ids are dropped, a missing file gives none."""
    from pairloom.operators.rank import parse_rank, parse_score

    df = read_table(spark, path)
    if not {"job_id", "resume_id"} <= set(df.columns):
        return spark.createDataFrame([], "job_id string, resume_id string, score double, rank int, source string")
    scores = [F.col(c) for c in ("score", "similarity", "match_score") if c in df.columns] or [F.lit("")]
    rank = parse_rank(F.col("rank")) if "rank" in df.columns else parse_rank(F.lit(""))
    out = df.select(F.trim("job_id").alias("job_id"), F.trim("resume_id").alias("resume_id"), parse_score(*scores).alias("score"), rank.alias("rank"), (F.col("source") if "source" in df.columns else F.lit("")).alias("source"))
    return out.where("job_id <> '' AND resume_id <> ''")


def skill_dictionary(spark: SparkSession, files: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(skill): the union of the files' skills, trimmed and lower-case. Each file names candidate columns; without a match the first column is taken; a candidate ending in * takes every column with that beginning."""
    out = None
    for path, candidates in files:
        df = read_table(spark, path, "\t" if path.endswith(".txt") else ",")
        cols = [c for k in candidates for c in df.columns if (c.lower().startswith(k[:-1].lower()) if k.endswith("*") else c.lower() == k.lower())]
        many = any(k.endswith("*") for k in candidates)
        cols = (cols if many else cols[:1]) or df.columns[:1]
        part = df.select(F.explode(F.array(*[F.lower(F.trim(f"`{c}`")) for c in cols])).alias("skill")).where("skill <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else spark.createDataFrame([], "skill string")


def write_csv(df: DataFrame, path: str, digits: int | None = 6, sep: str = ",") -> None:
    """Text with a header; doubles with a fixed number of digits, null as empty text. The target is replaced, by a committer, so a failed write leaves no half table."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" and digits is not None else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    df.select(*cols).na.fill("").write.mode("overwrite").option("header", "true").option("sep", sep).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_by_source(df: DataFrame, path: str) -> None:
    """Metrics as Parquet by source; writing a source again replaces it and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files at a path, read by the executors; a file may have up to 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, facts: DataFrame | None = None, inputs: Sequence[str] = (), **more) -> None:
    """A run's manifest as one JSON record on the shared file system: given facts, those of a (name, value) table, digests of the inputs, versions and the time in UTC."""
    row = {k: str(v) for k, v in more.items()} | ({r["name"]: str(r["value"]) for r in facts.collect()} if facts is not None else {})
    digests = [r.asDict() for p in inputs for r in file_digests(spark, p).collect()]
    made = spark.range(1).coalesce(1).select(
        F.create_map(*[F.lit(x) for k in sorted(row) for x in (k, row[k])]).alias("facts") if row else F.create_map().cast("map<string,string>").alias("facts"),
        F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in d.items()]) for d in digests]).alias("inputs"),
        F.lit(spark.version).alias("spark_version"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("written_at"),
    )
    made.write.mode("overwrite").json(path)
