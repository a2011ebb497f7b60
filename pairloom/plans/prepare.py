"""Queries of the general preparation operators (problems 1 and 5) with their SQL."""

from __future__ import annotations

from pairloom.operators import refs, rejects
from pairloom.session import table


def _p1(spark, d):
    return table(spark, d, "resume_clean_raw"), table(spark, d, "resume_clean_files"), rejects.rule_table(spark)


def p1_found(spark, d):
    return rejects.errors(*_p1(spark, d)).select("rec_id", "reason")


def p1_valid(spark, d):
    return rejects.valid_rows(*_p1(spark, d))


def p1_reasons(spark, d):
    from pyspark.sql import functions as F

    return rejects.errors(*_p1(spark, d)).groupBy("file_id", "reason", "detail").agg(F.count("*").alias("records"))


def _found5(spark, d):
    return refs.label_orphans(table(spark, d, "labels_clean_top10_strict"), table(spark, d, "resume_clean"), table(spark, d, "postings_clean"))


def p5_found(spark, d):
    return _found5(spark, d).select("label_row", "ref_column", "reason")


def p5_counts(spark, d):
    return refs.orphan_counts(_found5(spark, d))


def rejects_report(spark, d):
    """(which, row_index, id_if_any, reason) of the records that cannot be loaded, with their file's name and the text before the first delimiter."""
    from pyspark.sql import functions as F

    from pairloom.session import small_side

    raw, files, rules = _p1(spark, d)
    named = raw.join(small_side(files.select("file_id", "file_name", "delim")), "file_id").select("rec_id", "file_name", F.substring(F.element_at(F.split("rec_text", F.concat(F.lit("\\Q"), F.col("delim"), F.lit("\\E")), 2), 1), 1, 120).alias("id_if_any"))
    bad = rejects.errors(raw, files, rules).groupBy("rec_id").agg(F.min("reason").alias("reason"))
    return bad.join(named, "rec_id").select(F.col("file_name").alias("which"), F.col("rec_id").alias("row_index"), "id_if_any", "reason")


def csv_dialect_roundtrip(spark, d):
    """The postings, written once in each dialect and read back by detection: (dialect, row_num, title, description), null as empty text."""
    from pyspark.sql import functions as F

    from pairloom.session import shared_path
    from pairloom.sources import csv

    t = table(spark, d, "postings_clean").select("row_num", "title", "description", "company_name")
    out = None
    for name, sep in (("comma", ","), ("tab", "\t"), ("semicolon", ";"), ("bar", "|")):
        path = shared_path(spark, f"csv-{name}")
        csv.write_csv(t, path, sep=sep)
        back = csv.read_table(spark, path).select(F.lit(name).alias("dialect"), F.col("row_num").cast("long").alias("row_num"), "title", "description")
        out = back if out is None else out.unionByName(back)
    return out


QUERIES = {f.__name__: f for f in (p1_found, p1_valid, p1_reasons, p5_found, p5_counts, csv_dialect_roundtrip)} | {"rejects": rejects_report}

_CELLS = r"""
WITH r AS (SELECT rec_id, file_id, rec_text, delim, string_split(header_text, delim) AS names,
    CASE delim WHEN '|' THEN '\|' ELSE delim END AS dx,
    '("([^"]|"")*"|[^"' || delim || ']*)' AS field
  FROM resume_clean_raw JOIN resume_clean_files USING (file_id)),
c AS (SELECT *, regexp_full_match(rec_text, '(?s)' || field || '(' || dx || field || ')*') AS quoted_well,
    regexp_extract_all(delim || rec_text, '(?s)' || dx || field, 1) AS cells FROM r),
v AS (SELECT rec_id, file_id, names, quoted_well, cells, len(cells) = len(names) AS counted_well,
    list_transform(cells, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS vals FROM c),
w AS (SELECT *, vals[list_position(names, 'ID')] AS id, vals[list_position(names, 'Resume_str')] AS txt,
    vals[list_position(names, 'years_experience')] AS yrs, vals[list_position(names, 'updated_on')] AS upd,
    vals[list_position(names, 'Category')] AS cat, vals[list_position(names, 'Gender')] AS gen FROM v WHERE quoted_well AND counted_well),
x AS (SELECT *, NOT regexp_full_match(id, '[A-Za-z0-9_-]{3,}') AS bad_id, NOT regexp_matches(txt, '[^\s\v\p{Z}\x{85}\x1c-\x1f]') AS bad_txt,
    yrs <> '' AND NOT coalesce(regexp_full_match(yrs, '[0-9]+') AND TRY_CAST(yrs AS HUGEINT) BETWEEN 0 AND 60, false) AS bad_yrs,
    upd <> '' AND NOT (regexp_full_match(upd, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(upd AS DATE) IS NOT NULL) AS bad_upd FROM w)
"""
_ERRORS = _CELLS + """, e AS (
SELECT rec_id, file_id, 'quoting' AS reason, '' AS detail FROM v WHERE NOT quoted_well
UNION ALL SELECT rec_id, file_id, 'column_count', '' FROM v WHERE quoted_well AND NOT counted_well
UNION ALL SELECT rec_id, file_id, 'invalid_value', concat_ws(',', CASE WHEN bad_id THEN 'ID' END, CASE WHEN bad_txt THEN 'Resume_str' END, CASE WHEN bad_upd THEN 'updated_on' END, CASE WHEN bad_yrs THEN 'years_experience' END)
  FROM x WHERE bad_id OR bad_txt OR bad_yrs OR bad_upd)
"""

_REFS = r"""
WITH refs AS (
  SELECT label_row, 'job_id' AS ref_column, 'postings_clean' AS target, trim(job_id, E' \t') AS k, labeled_at AS ts FROM labels_clean_top10_strict
  UNION ALL SELECT label_row, 'resume_id', 'resume_clean', trim(resume_id, E' \t'), labeled_at FROM labels_clean_top10_strict),
parents AS (
  SELECT 'postings_clean' AS target, trim(job_id, E' \t') AS k, loaded_at, deleted_at FROM postings_clean
  UNION ALL SELECT 'resume_clean', trim(ID, E' \t'), loaded_at, deleted_at FROM resume_clean),
j AS (SELECT r.label_row, r.ref_column, r.target, r.ts, count(p.k) AS n,
    count(*) FILTER (WHERE p.loaded_at <= r.ts) AS loaded,
    count(*) FILTER (WHERE p.loaded_at <= r.ts AND (p.deleted_at IS NULL OR p.deleted_at > r.ts)) AS live
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.k = r.k WHERE r.k <> '' GROUP BY ALL),
found AS (SELECT label_row, ref_column, target, ts, CASE WHEN n = 0 THEN 'missing' WHEN loaded > 0 THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE live = 0)
"""

ORACLE = {
    "p1_found": _ERRORS + "SELECT rec_id, reason FROM e",
    "p1_reasons": _ERRORS + "SELECT file_id, reason, detail, count(*) AS records FROM e GROUP BY ALL",
    "p1_valid": _CELLS + """SELECT rec_id, file_id, id AS ID, txt AS Resume_str, nullif(cat, '') AS Category, nullif(gen, '') AS Gender,
  CAST(nullif(yrs, '') AS INTEGER) AS years_experience, CAST(nullif(upd, '') AS DATE) AS updated_on FROM x WHERE NOT (bad_id OR bad_txt OR bad_yrs OR bad_upd)""",
    "rejects": _ERRORS + "SELECT file_name AS which, rec_id AS row_index, substr(string_split(rec_text, delim)[1], 1, 120) AS id_if_any, e.reason FROM e JOIN resume_clean_raw USING (rec_id) JOIN resume_clean_files ON resume_clean_files.file_id = resume_clean_raw.file_id",
    "csv_dialect_roundtrip": "SELECT dialect, row_num, coalesce(title, '') AS title, coalesce(description, '') AS description FROM postings_clean, (VALUES ('comma'), ('tab'), ('semicolon'), ('bar')) v(dialect)",
    "p5_found": _REFS + "SELECT label_row, ref_column, reason FROM found",
    "p5_counts": _REFS + "SELECT target, strftime(ts, '%Y-%m') AS month, reason, count(*) AS orphans FROM found GROUP BY ALL",
}
