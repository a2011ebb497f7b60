"""Queries of the corpus operators with their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.llm import encoding, markup, mix, pii, sentences, terms, tokens, topn
from pairloom.session import cut, table


def texts(spark, d):
    """The resumes' and postings' texts as (table_name, row_num, text)."""
    a = table(spark, d, "resume_clean").select(F.lit("resume_clean").alias("table_name"), "row_num", F.col("Resume_str").alias("text"))
    b = table(spark, d, "postings_clean").select(F.lit("postings_clean").alias("table_name"), "row_num", F.col("description").alias("text"))
    return a.unionByName(b)


def p2_restored(spark, d):
    """Every affected row with its text as far as it can be restored."""
    dicts = encoding.fit(table(spark, d, "documents"))
    return encoding.restored(texts(spark, d), ["table_name", "row_num"], "text", dicts)


def p2_found(spark, d):
    return p2_restored(spark, d).select("table_name", "row_num")


def p3_found(spark, d):
    found = pii.items(table(spark, d, "resume_clean"), "row_num", "Resume_str")
    return found.select("row_num", "kind", F.col("value").alias("found_value")).distinct()


def p3_redacted(spark, d):
    return pii.redacted(table(spark, d, "resume_clean"), "row_num", "Resume_str")


def p4_found(spark, d):
    return markup.found(texts(spark, d), ["table_name", "row_num"], "text")


def p4_clean(spark, d):
    return markup.cleaned(texts(spark, d), ["table_name", "row_num"], "text")


def p6_found(spark, d):
    return terms.top_terms(texts(spark, d), weight="tf").select("table_name", "row_num", "term")


def p6_graph_terms(spark, d):
    return terms.top_terms(texts(spark, d), weight="gow", k=5)


def p7_found(spark, d):
    return topn.top_n(table(spark, d, "job_to_resumes_top10_tfidf"), "job_id", "resume_id", "score", 10).select("job_id", "resume_id", "place")


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark, d):
    """Per document the number of ids and whether decoding them gives the text again."""
    docs = table(spark, d, "documents")
    enc = cut(tokens.encode(docs, "doc_id", "text"))
    back = tokens.decode(enc, "doc_id", "ids").withColumnRenamed("text", "back")
    j = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").join(enc.select("doc_id", F.size("ids").alias("n_ids")), "doc_id")
    return j.select("doc_id", "n_ids", (F.col("text") == F.col("back")).alias("same"))


def p9_mix(spark, d):
    chosen, _ = mix.mixed(table(spark, d, "documents"), table(spark, d, "source_targets"))
    return chosen.withColumnRenamed("src", "source")


def p9_shares(spark, d):
    return mix.shares(*mix.mixed(table(spark, d, "documents"), table(spark, d, "source_targets")))


def p10_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_restored, p3_found, p3_redacted, p4_found, p4_clean, p10_found, p6_found, p6_graph_terms, p7_found, p8_ids, p8_roundtrip, p9_mix, p9_shares)}

ORACLE = {
    "p6_found": r"""
WITH t AS (SELECT 'resume_clean' AS table_name, row_num, Resume_str AS x FROM resume_clean UNION ALL SELECT 'postings_clean', row_num, description FROM postings_clean),
w AS (SELECT table_name, row_num, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}_]{2,}')) AS term FROM t),
f AS (SELECT table_name, row_num, term, count(*) AS f FROM w GROUP BY ALL),
d AS (SELECT term, count(*) AS d FROM f GROUP BY term HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT table_name, row_num FROM f)),
s AS (SELECT table_name, row_num, term, round(f * ln(n / CAST(d AS DOUBLE)), 6) AS s FROM f JOIN d USING (term), n)
SELECT table_name, row_num, term FROM s QUALIFY row_number() OVER (PARTITION BY table_name, row_num ORDER BY s DESC, term) = 1""",
    "p6_graph_terms": r"""
WITH t AS (SELECT 'resume_clean' AS table_name, row_num, Resume_str AS x FROM resume_clean UNION ALL SELECT 'postings_clean', row_num, description FROM postings_clean),
k AS (SELECT table_name, row_num, regexp_extract_all(lower(x), '[\p{L}\p{N}_]{2,}') AS ts FROM t WHERE x IS NOT NULL),
w AS (SELECT table_name, row_num, unnest(ts) AS term, generate_subscripts(ts, 1) AS p FROM k WHERE len(ts) > 0),
e AS (SELECT a.table_name, a.row_num, a.term AS x, b.term AS y FROM w a JOIN w b ON a.table_name = b.table_name AND a.row_num = b.row_num AND b.p = a.p + 1
  UNION ALL SELECT a.table_name, a.row_num, a.term, b.term FROM w a JOIN w b ON a.table_name = b.table_name AND a.row_num = b.row_num AND b.p = a.p + 2),
g AS (SELECT table_name, row_num, x AS term, count(DISTINCT y) AS degree FROM (SELECT table_name, row_num, x, y FROM e UNION ALL SELECT table_name, row_num, y, x FROM e) WHERE x <> y GROUP BY ALL),
f AS (SELECT DISTINCT table_name, row_num, term FROM w),
d AS (SELECT term, count(*) AS d FROM f GROUP BY term HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT table_name, row_num FROM f)),
s AS (SELECT table_name, row_num, term, round(coalesce(degree, 0) * ln(n / CAST(d AS DOUBLE)), 6) AS score FROM f JOIN d USING (term) LEFT JOIN g USING (table_name, row_num, term), n)
SELECT table_name, row_num, term, score, CAST(row_number() OVER (PARTITION BY table_name, row_num ORDER BY score DESC, term) AS INTEGER) AS place FROM s
QUALIFY row_number() OVER (PARTITION BY table_name, row_num ORDER BY score DESC, term) <= 5""",
    "p7_found": """
WITH m AS (SELECT job_id, resume_id, max(score) AS s FROM job_to_resumes_top10_tfidf
  WHERE job_id IS NOT NULL AND resume_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
SELECT job_id, resume_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY s DESC, resume_id) AS INTEGER) AS place FROM m
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY s DESC, resume_id) <= 10""",
}
