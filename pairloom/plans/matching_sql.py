"""SQL of the matching queries for another engine, written independently of the DataFrame plans."""

from __future__ import annotations

from pairloom.operators.text import BLOCKS, DROPPED, ENTITIES, REFERENCE
from pairloom.plans.matching import SKILLS as SIGNED_SKILLS

TOK2, TOK1 = r"[\p{L}\p{N}_]{2,}", r"[\p{L}\p{N}_]+"

RES = "res AS (SELECT trim(ID) AS id, arg_min(coalesce(Resume_str, ''), row_num) AS text FROM resume_clean WHERE trim(ID) <> '' GROUP BY 1)"
JOBS = "job AS (SELECT trim(job_id) AS id, arg_min(coalesce(description, ''), row_num) AS text FROM postings_clean WHERE trim(job_id) <> '' GROUP BY 1)"
QJ = "q AS (SELECT DISTINCT trim(job_id) AS id FROM postings_clean WHERE trim(job_id) <> '')"
QR = "q AS (SELECT DISTINCT trim(ID) AS id FROM resume_clean WHERE trim(ID) <> '')"
_PAIRS = "SELECT trim(job_id) AS job_id, trim(resume_id) AS resume_id, {agg}(score) AS score FROM job_to_resumes_top10_tfidf WHERE job_id IS NOT NULL AND resume_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score){more} GROUP BY 1, 2"
PAIRS = "prs AS (" + _PAIRS.format(agg="max", more="") + ")"
_TOP = "SELECT job_id, resume_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY job_id ORDER BY round(score, 6) DESC, resume_id) AS INTEGER) AS rank FROM {src} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY round(score, 6) DESC, resume_id) <= 10"
STORED = PAIRS + ", stored AS (" + _TOP.format(src="prs") + ")"
OTHER = "prs2 AS (" + _PAIRS.format(agg="min", more="") + "), other AS (" + _TOP.format(src="prs2") + ")"
LABELS = r"""lab AS (SELECT trim(job_id, E' \t') AS job_id, trim(resume_id, E' \t') AS resume_id, arg_max(CASE WHEN CAST(label AS VARCHAR) IN ('1', 'true', 'True') THEN 1 ELSE 0 END, label_row) AS y
  FROM labels_clean_top10_strict WHERE label IS NOT NULL AND trim(job_id, E' \t') <> '' AND trim(resume_id, E' \t') <> '' GROUP BY 1, 2)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _rank_sql(direction: str, method: str, scores: str, left: str, right: str, cand: str) -> str:
    return f""", full_ AS (SELECT q.id AS l, c.id AS r, round(coalesce(s.score, 0.0), 6) + 0.0 AS score FROM qq q CROSS JOIN {cand} c LEFT JOIN ({scores}) s ON s.q = q.id AND s.d = c.id)
SELECT l AS {left}, r AS {right}, score, CAST(row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS INTEGER) AS rank, '{method}' AS source FROM full_
QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, r) <= 10"""


def tfidf_sql(direction: str) -> str:
    q, side, docs, left, right = (QJ, "job", "res", "job_id", "resume_id") if direction == "job" else (QR, "res", "job", "resume_id", "job_id")
    return with_(
        RES, JOBS, q, f"qq AS (SELECT s.id, s.text FROM {side} s JOIN q USING (id))",
        f"words AS (SELECT 'res' AS k, id, unnest(regexp_extract_all(lower(text), '{TOK2}')) AS t FROM res UNION ALL SELECT 'job', id, unnest(regexp_extract_all(lower(text), '{TOK2}')) FROM job)",
        "tf AS (SELECT k, id, t, count(*) AS f FROM words GROUP BY ALL)",
        "n AS (SELECT (SELECT count(*) FROM res) + (SELECT count(*) FROM job) AS n)",
        "idf AS (SELECT t, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM tf, n GROUP BY t, n)",
        "w AS (SELECT k, id, t, f * idf AS w FROM tf JOIN idf USING (t))",
        "u AS (SELECT k, id, t, w / sqrt(sum(w * w) OVER (PARTITION BY k, id)) AS u FROM w)",
    ).rstrip() + _rank_sql(direction, "tfidf", f"SELECT a.id AS q, b.id AS d, sum(a.u * b.u) AS score FROM u a JOIN u b USING (t) WHERE a.k = '{side}' AND b.k = '{docs}' AND a.id IN (SELECT id FROM qq) GROUP BY 1, 2", left, right, docs)


def bm25_sql(direction: str) -> str:
    q, side, docs, left, right = (QJ, "job", "res", "job_id", "resume_id") if direction == "job" else (QR, "res", "job", "resume_id", "job_id")
    return with_(
        RES, JOBS, q, f"qq AS (SELECT s.id, s.text FROM {side} s JOIN q USING (id))",
        f"tf AS (SELECT id, t, count(*) AS f FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{TOK1}')) AS t FROM {docs}) GROUP BY ALL)",
        f"qf AS (SELECT id, t, count(*) AS qf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{TOK1}')) AS t FROM qq) GROUP BY ALL)",
        f"st AS (SELECT (SELECT count(*) FROM {docs}) AS n, (SELECT sum(f) FROM tf) / CAST((SELECT count(*) FROM {docs}) AS DOUBLE) AS avgdl)",
        "idf AS (SELECT t, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM tf, st GROUP BY t, n)",
        "dl AS (SELECT id, sum(f) AS dl FROM tf GROUP BY id)",
    ).rstrip() + _rank_sql(direction, "bm25", "SELECT qf.id AS q, tf.id AS d, sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qf JOIN tf USING (t) JOIN idf USING (t) JOIN dl ON dl.id = tf.id, st GROUP BY 1, 2", left, right, docs)


def eval_sql(variant: str) -> str:
    parts = with_(
        STORED, LABELS,
        "h AS (SELECT s.job_id, s.rank, l.y, coalesce(l.y, 0) AS hit FROM stored s LEFT JOIN lab l USING (job_id, resume_id))",
        "g AS (SELECT *, sum(hit) OVER (PARTITION BY job_id ORDER BY rank) AS seen FROM h)",
        "per AS (SELECT job_id, sum(hit) AS hits, count(y) AS labelled, sum(hit / log2(rank + 1.0)) AS dcg, sum(hit * seen / CAST(rank AS DOUBLE)) AS prec FROM g GROUP BY job_id)",
        "pos AS (SELECT job_id, sum(y) AS positives FROM lab GROUP BY job_id)",
        "ideal AS (SELECT n, coalesce((SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= n), 0.0) AS d FROM range(0, 11) r(n))",
        "j AS (SELECT per.*, coalesce(positives, 0) AS positives, a.d AS found, b.d AS total FROM per LEFT JOIN pos USING (job_id) JOIN ideal a ON a.n = per.hits JOIN ideal b ON b.n = least(coalesce(positives, 0), 10))",
    )
    p = "round(sum(hits) / (count(*) * 10.0), 6) AS p_at_k"
    body = {
        "labelled": f"SELECT 'stored' AS source, {p}, round(avg(CASE WHEN found > 0 THEN dcg / found ELSE 0 END), 6) AS ndcg_at_k, round(avg(CASE WHEN hits > 0 THEN prec / hits ELSE 0 END), 6) AS map_at_k, count(*) AS jobs_scored FROM j WHERE labelled > 0",
        "all": f"SELECT 'stored' AS source, {p}, round(sum(dcg) / sum(CASE WHEN found > 0 THEN found ELSE 1.0 END), 6) AS ndcg_at_k, round(avg(CASE WHEN hits > 0 THEN prec / hits ELSE 0 END), 6) AS map_at_k, count(*) AS jobs_scored FROM j",
        "positives": f"SELECT 'stored' AS source, {p}, round(avg(CASE WHEN total > 0 THEN dcg / total ELSE 0 END), 6) AS ndcg_at_k, round(avg(CASE WHEN positives > 0 THEN prec / least(positives, 10) ELSE 0 END), 6) AS map_at_k, count(*) AS jobs_scored FROM j",
        "precision": f"SELECT 'stored' AS source, {p}, CAST(NULL AS DOUBLE) AS ndcg_at_k, CAST(NULL AS DOUBLE) AS map_at_k, count(*) AS jobs_scored FROM j",
    }
    return parts + body[variant]


def _group(c: str) -> str:
    return f"lower(coalesce(nullif(trim({c}), ''), 'missing'))"


POP = f"pop AS (SELECT trim(ID) AS resume_id, arg_max({_group('Gender')}, row_num) AS Gender, arg_max({_group('Ethnicity')}, row_num) AS Ethnicity FROM resume_clean WHERE trim(ID) <> '' GROUP BY 1)"


def _parity(inter: bool) -> str:
    long_ = "SELECT resume_id, 'Gender' AS attribute, Gender AS grp FROM pop UNION ALL SELECT resume_id, 'Ethnicity', Ethnicity FROM pop" + (" UNION ALL SELECT resume_id, 'Gender|Ethnicity', Gender || '|' || Ethnicity FROM pop" if inter else "")
    return ", ".join([
        STORED, POP, f"lg AS ({long_})",
        "tot AS (SELECT CAST((SELECT count(DISTINCT job_id) FROM stored) * 10 AS DOUBLE) AS n, CAST((SELECT count(*) FROM pop) AS DOUBLE) AS people)",
        "base AS (SELECT attribute, grp, count(*) AS resume_count FROM lg GROUP BY ALL)",
        "rec AS (SELECT attribute, grp, count(*) AS rec_count FROM stored JOIN lg USING (resume_id) GROUP BY ALL)",
        "au AS (SELECT attribute, grp, resume_count, people, coalesce(rec_count, 0) AS rec_count, n, coalesce(rec_count, 0) / n AS p, resume_count / people AS b FROM base LEFT JOIN rec USING (attribute, grp), tot)",
        """audit AS (SELECT attribute, grp AS "group", resume_count, CAST(people AS BIGINT) AS total_resumes, rec_count, CAST(n AS BIGINT) AS total_selected, round(p, 6) AS share_selected,
  round(greatest(0.0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS share_selected_lo,
  round(least(1.0, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS share_selected_hi,
  round(b, 6) AS base_share, CASE WHEN resume_count >= 30 THEN round(p / b, 6) END AS parity_ratio, CASE WHEN resume_count >= 30 THEN round((p - b) * 100, 6) END AS parity_diff_pp, CASE WHEN resume_count >= 30 THEN '' ELSE 'low_support' END AS note FROM au)""",
    ])


WEIGHTS = """wa AS (SELECT attribute, "group" AS grp, share_selected AS share, base_share AS base, CAST(total_selected AS DOUBLE) AS n, avg(base_share) FILTER (WHERE base_share > 0) OVER (PARTITION BY attribute) AS mean FROM audit),
wb AS (SELECT attribute, grp, greatest(0.85, least(1.2, CASE WHEN base > 0 THEN base / greatest((share * n + 50.0 * mean) / (n + 50.0), 1e-6) ELSE 0 END)) AS c FROM wa),
wt AS (SELECT attribute, grp, round(c / avg(c) OVER (PARTITION BY attribute), 6) AS weight FROM wb)"""
RERANK = """rr AS (SELECT p.job_id, p.resume_id, round(p.score * exp((ln(coalesce(g.weight, 1.0)) + ln(coalesce(e.weight, 1.0))) / 2.0), 6) AS score FROM prs p LEFT JOIN pop USING (resume_id)
  LEFT JOIN wt g ON g.attribute = 'Gender' AND g.grp = coalesce(pop.Gender, 'missing') LEFT JOIN wt e ON e.attribute = 'Ethnicity' AND e.grp = coalesce(pop.Ethnicity, 'missing')),
adj AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, resume_id) AS INTEGER) AS rank FROM rr QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY score DESC, resume_id) <= 10)"""


def _sel(ranking: str, name: str = "sel") -> str:
    return f"{name} AS (SELECT p.job_id, p.resume_id, coalesce('Gender=' || pop.Gender || '|Ethnicity=' || pop.Ethnicity, 'unknown') AS grp, CASE WHEN s.rank <= 10 THEN 1 ELSE 0 END AS y_pred FROM prs p LEFT JOIN {ranking} s USING (job_id, resume_id) LEFT JOIN pop ON pop.resume_id = p.resume_id)"


SKILLS = "sk AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[a-z]{6,}')) AS skill FROM postings_clean)"


def _skill_edges(docs: str, name: str) -> str:
    # word boundaries as in the other engine: a match may not touch letters, digits or _; _ itself became a blank
    return rf"{name} AS (SELECT DISTINCT id, skill FROM (SELECT id, unnest(regexp_extract_all(regexp_replace(lower(text), '[-_/]', ' ', 'g'), '{TOK1}')) AS skill FROM {docs}) JOIN sk USING (skill))"


GRAPH = ", ".join([RES, JOBS, SKILLS, _skill_edges("res", "re"), _skill_edges("job", "je"), "e AS (SELECT 'resume_' || id AS src, 'skill_' || skill AS dst FROM re UNION SELECT 'job_' || id, 'skill_' || skill FROM je)"])
EDGES = STORED + ", " + OTHER + ", ia AS (SELECT job_id, resume_id FROM stored UNION SELECT job_id, resume_id FROM other), e AS (SELECT 'job_' || job_id AS src, 'resume_' || resume_id AS dst FROM ia), bd AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), dg AS (SELECT src AS node, count(*) AS degree FROM bd GROUP BY 1), ad AS (SELECT b.src, b.dst, 1.0 / sqrt(CAST(s.degree AS DOUBLE) * t.degree) AS w FROM bd b JOIN dg s ON s.node = b.src JOIN dg t ON t.node = b.dst)"


def _seeded(node: str, dim: str) -> str:
    return f"(CAST('0x' || substr(md5('42|' || {node} || '|' || CAST({dim} AS VARCHAR)), 1, 7) AS BIGINT) / 134217728.0 - 1.0)"


X0 = f"x0 AS (SELECT node, CAST(dim AS INTEGER) AS dim, {_seeded('node', 'dim')} AS x FROM dg, range(0, 4) r(dim))"
NEG = """ri AS (SELECT resume_id, row_number() OVER (ORDER BY resume_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT resume_id FROM ia)),
dr AS (SELECT job_id, draw, CAST('0x' || substr(md5('42|' || job_id || '|' || CAST(draw AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM (SELECT DISTINCT job_id FROM ia), range(0, {draws}) r(draw)),
dn AS (SELECT job_id, resume_id, min(draw) AS draw FROM dr JOIN ri ON ri.idx = dr.h % ri.n WHERE (job_id, resume_id) NOT IN (SELECT (job_id, resume_id) FROM ia) GROUP BY 1, 2),
ng AS (SELECT job_id, resume_id, CAST(draw AS INTEGER) AS draw FROM dn QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY draw) <= {per})"""


def _cosine(fwd: bool) -> str:
    q, r = ("vec_id % 100 = 0", "vec_id % 2 = 1") if fwd else ("vec_id % 100 = 1", "vec_id % 2 = 0")
    left, right = ("job_id", "resume_id") if fwd else ("resume_id", "job_id")
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT CAST(a.vec_id AS VARCHAR) AS l, CAST(b.vec_id AS VARCHAR) AS r, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS score
  FROM (SELECT * FROM v WHERE {q}) a CROSS JOIN (SELECT * FROM v WHERE {r}) b)
SELECT l AS {left}, r AS {right}, score, CAST(row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, r) <= 10"""


_Q = lambda x: "'" + x.replace("'", "''") + "'"
_NAMES = "map([" + ", ".join(_Q(k) for k in ENTITIES) + "], [" + ", ".join(_Q(v) for v in ENTITIES.values()) + "])"


def _unescape(c: str) -> str:
    number = "CASE WHEN starts_with(lower(p), '&#x') THEN CAST('0x' || rtrim(p[4:], ';') AS BIGINT) ELSE CAST(rtrim(p[3:], ';') AS BIGINT) END"
    return rf"array_to_string(list_transform(regexp_extract_all({c}, '{REFERENCE}'), lambda p: CASE WHEN NOT starts_with(p, '&') OR length(p) < 3 THEN p WHEN starts_with(p, '&#') THEN chr(CAST({number} AS INT)) ELSE coalesce(m[p[2:]], p) END), '')"


ENT = f"ent AS MATERIALIZED (SELECT {_NAMES} AS m)"


def _squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[ \t\n\v\f\r]+', ' ', 'g'))"


def _strip(c: str) -> str:
    return _squeeze(rf"regexp_replace({_unescape(c)}, '<[^>]+>', ' ', 'g')")


def _parsed(c: str) -> str:
    """The parser form for well-formed text: dropped elements and comments go, block tags part words, other tags vanish."""
    x = _unescape(c)
    for t in sorted(DROPPED):
        x = rf"regexp_replace({x}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->|<!\[.*?\]\s*\]\s*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(?:{'|'.join(sorted(BLOCKS))})(?:[\s/][^<>]*)?>|</(?:{'|'.join(sorted(BLOCKS))})(?:[\s/][^>]*)?>', ' ', 'g')"
    x = rf"regexp_replace({x}, '<[A-Za-z][^<>]*>|</[A-Za-z][^>]*>', '', 'g')"
    return rf"trim(regexp_replace({_unescape(x)}, '[\s\v\x{{85}}\x1c-\x1f\p{{Z}}]+', ' ', 'g'))"


_DESC = "trim(concat_ws(' ', coalesce(description, ''), coalesce(skills_desc, '')))"
CLEAN = ENT + f""", c0 AS (SELECT *, {_DESC} AS d0 FROM postings_clean), c1 AS (SELECT c0.*, CASE WHEN contains(d0, '<') OR contains(d0, '&lt;') THEN {_parsed('d0')} ELSE d0 END AS d1, trim(coalesce(job_id, '')) AS k FROM c0, ent),
c2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_num) AS rn FROM c1 WHERE length(d1) >= 40)"""
_CELLS = "concat_ws(' ', coalesce(ID, ''), coalesce(Resume_str, ''), coalesce(Category, ''))"
REPAIR = rf"""i0 AS (SELECT row_num + 1 AS n, trim(coalesce(ID, '')) AS old, lower(trim(coalesce(ID, ''))) AS lo, {_CELLS} AS cells, coalesce(Resume_str, '') AS txt, concat_ws('||', coalesce(ID, ''), coalesce(Resume_str, ''), coalesce(Category, '')) AS bars FROM resume_clean),
i1 AS (SELECT *, NOT regexp_full_match(old, '[A-Za-z0-9_-]{{3,}}') OR contains(lo, '<') OR contains(lo, '>') OR contains(lo, 'div') OR contains(lo, 'http') OR contains(lo, 'margin-left') OR contains(lo, 'class=') AS bad,
  regexp_extract(' ' || cells || ' ', '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])([0-9]{{7,}})(?:[^\p{{L}}\p{{N}}\p{{M}}_]|$)', 1) AS dig, regexp_extract(cells, 'id="([A-Za-z0-9_-]{{6,}})"', 1) AS quo FROM i0),
i2 AS (SELECT n, old, bars, CASE WHEN NOT bad THEN old WHEN dig <> '' THEN dig WHEN quo <> '' THEN quo ELSE 'syn_' || substr(sha1(txt || '#' || n), 1, 10) || '_' || n END AS id, CASE WHEN NOT bad THEN 'kept' WHEN dig <> '' OR quo <> '' THEN 'repaired' ELSE 'synth' END AS action FROM i1),
i3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY n) = 1 THEN id ELSE id || '_' || substr(sha1(bars || '@' || n), 1, 6) END AS id2 FROM i2),
rep AS (SELECT n AS row_index, substr(old, 1, 120) AS old_id, CASE WHEN row_number() OVER (PARTITION BY id2 ORDER BY n) = 1 THEN id2 ELSE id2 || 'x' END AS new_id, action FROM i3)"""

_MET = """m AS (SELECT 'tfidf' AS method, p_at_k AS p, ndcg_at_k AS ndcg, map_at_k AS map, jobs_scored FROM ({a}) UNION ALL SELECT 'default', p_at_k, ndcg_at_k, map_at_k, jobs_scored FROM ({b}))"""
METRICS = "WITH " + _MET.format(a=eval_sql("all"), b=eval_sql("all").replace(STORED, OTHER + ", stored AS (SELECT * FROM other)"))

HASH = "eh AS (SELECT DISTINCT md5(least(src, dst) || '-' || greatest(src, dst)) AS h FROM e), hashed AS (SELECT md5(CAST(count(*) AS VARCHAR) || " + " || ".join(f"'|' || CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 7 * i}, 7) AS BIGINT)), 0) AS VARCHAR)" for i in range(4)) + ") AS graph_hash FROM eh)"
ORACLE = {
    "tfidf_job_to_resumes_top10": tfidf_sql("job"), "tfidf_resume_to_jobs_top10": tfidf_sql("resume"), "bm25_job_to_resumes_top10": bm25_sql("job"), "bm25_resume_to_jobs_top10": bm25_sql("resume"),
    "tfidf_idf_table": with_(RES, JOBS, f"w AS (SELECT DISTINCT k, id, t FROM (SELECT 'r' AS k, id, unnest(regexp_extract_all(lower(text), '{TOK2}')) AS t FROM res UNION ALL SELECT 'j', id, unnest(regexp_extract_all(lower(text), '{TOK2}')) FROM job))", "n AS (SELECT (SELECT count(*) FROM res) + (SELECT count(*) FROM job) AS n)") + "SELECT t AS token, count(*) AS df, round(ln((1.0 + n) / (1.0 + count(*))) + 1.0, 6) AS idf FROM w, n GROUP BY t, n",
    "bm25_corpus_stats": with_(RES, f"t AS (SELECT unnest(regexp_extract_all(lower(text), '{TOK1}')) AS t FROM res)") + "SELECT (SELECT count(*) FROM res) AS docs, count(*) AS tokens, count(DISTINCT t) AS vocabulary, round(count(*) / CAST((SELECT count(*) FROM res) AS DOUBLE), 6) AS avgdl FROM t",
    "stored_top10": with_(STORED) + "SELECT * FROM stored",
    "method_overlap_at10": with_(STORED, OTHER) + "SELECT (SELECT count(*) FROM stored JOIN other USING (job_id, resume_id)) AS common, count(*) AS jobs, round((SELECT count(*) FROM stored JOIN other USING (job_id, resume_id)) / (10.0 * count(*)), 6) AS overlap FROM (SELECT job_id FROM stored INTERSECT SELECT job_id FROM other)",
    "consensus_proxy": with_(STORED, OTHER, "o AS (SELECT (SELECT count(*) FROM stored JOIN other USING (job_id, resume_id)) / (10.0 * count(*)) AS v FROM (SELECT job_id FROM stored INTERSECT SELECT job_id FROM other))") + "SELECT 'stored' AS source, round(v, 4) AS p_at_10 FROM o UNION ALL SELECT 'least', round(v, 4) FROM o",
    "coverage_full_k": with_(STORED) + "SELECT count(*) FILTER (WHERE n >= 10) AS \"full\", count(*) AS jobs, round(avg(CASE WHEN n >= 10 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM (SELECT job_id, count(*) AS n FROM stored GROUP BY 1)",
    "shortlist_delta_rank": with_(STORED, OTHER) + "SELECT s.job_id, s.resume_id, s.rank AS rank_pre, o.rank AS rank_post, o.rank - s.rank AS delta FROM stored s LEFT JOIN other o USING (job_id, resume_id)",
    "eval_labelled_jobs": eval_sql("labelled"), "eval_all_jobs_pooled": eval_sql("all"), "eval_total_positives": eval_sql("positives"), "precision_at_k": eval_sql("precision"),
    "label_rules_matrix": """WITH l AS (SELECT unnest(['1', '1.0', 'true', 'TRUE', 'True', '0.6', '0', 'yes', 't', '', '-1', '2']) AS label), v AS (SELECT label, TRY_CAST(label AS DOUBLE) AS x FROM l)
SELECT label, CAST(label IN ('1', 'true', 'True') AS INTEGER) AS rule_exact, coalesce(CAST(trunc(x) >= 1 AS INTEGER), 0) AS rule_at_least_one, coalesce(CAST(trunc(x) > 0 AS INTEGER), 0) AS rule_positive, CAST(trunc(x) AS INTEGER) AS rule_number,
 CAST(lower(label) IN ('1', 'true', 'yes') AS INTEGER) AS rule_yes, CAST(lower(label) IN ('1', 'true', 't', 'yes', 'y', '1.0') AS INTEGER) AS rule_wide, coalesce(CAST(x > 0.5 AS INTEGER), 0) AS rule_above_half FROM v""",
    "parity_audit": "WITH " + _parity(False) + " SELECT * FROM audit", "parity_audit_intersection": "WITH " + _parity(True) + " SELECT * FROM audit",
    "parity_per_job": "WITH " + _parity(False) + ' SELECT job_id, attribute, grp AS "group", count(*) AS rec_count, round(count(*) / 10.0, 6) AS share_selected FROM stored JOIN lg USING (resume_id) GROUP BY 1, 2, 3',
    "parity_summary_rule80": "WITH " + _parity(False) + " SELECT attribute, coalesce(min(parity_ratio), 1.0) AS worst_ratio, coalesce(min(parity_diff_pp), 0.0) AS worst_diff_pp, coalesce(min(parity_ratio), 1.0) >= 0.8 AS rule_80_pass FROM audit GROUP BY attribute",
    "fairness_weights": "WITH " + _parity(False) + ", " + WEIGHTS + ' SELECT attribute, grp AS "group", weight FROM wt',
    "fair_rerank_top10": "WITH " + ", ".join([_parity(False), WEIGHTS, RERANK]) + " SELECT job_id, resume_id, score, rank, 'adjusted' AS source FROM adj",
    "selection_rate_audit": with_(STORED, POP, _sel("stored")) + 'SELECT grp AS "group", count(*) AS count, round(avg(y_pred), 6) AS selection_rate FROM sel GROUP BY grp',
    "dp_summary": with_(STORED, POP, _sel("stored"), "g AS (SELECT avg(y_pred) AS r, sum(y_pred) AS y, count(*) AS n FROM sel GROUP BY grp)") + "SELECT round(sum(y) / sum(n), 6) AS overall, round(max(r) - min(r), 6) AS dp_difference, round(CASE WHEN max(r) > 0 THEN min(r) / max(r) ELSE 1.0 END, 6) AS dp_ratio FROM g",
    "tpr_by_group": with_(STORED, POP, LABELS, _sel("stored")) + 'SELECT grp AS "group", count(*) AS count_labelled, round(avg(y_pred) FILTER (WHERE y = 1), 6) AS tpr FROM sel JOIN lab USING (job_id, resume_id) GROUP BY grp',
    "fairness_pre_post_merge": "WITH " + ", ".join([_parity(False), WEIGHTS, RERANK, _sel("stored"), _sel("adj", "sel2")]) + " SELECT grp AS \"group\", 'pre' AS stage, round(avg(y_pred), 6) AS selection_rate FROM sel GROUP BY grp UNION ALL SELECT grp, 'post', round(avg(y_pred), 6) FROM sel2 GROUP BY grp",
    "skill_dictionary": with_(SKILLS) + "SELECT skill FROM sk",
    "skill_edges": "WITH " + GRAPH + " SELECT id AS resume_id, skill FROM re",
    "graph_nodes_edges": "WITH " + GRAPH + " SELECT 'resume' AS part, count(*) AS n FROM res UNION ALL SELECT 'job', count(*) FROM job UNION ALL SELECT 'skill', count(DISTINCT dst) FROM e UNION ALL SELECT split_part(src, '_', 1) || '-skill', count(*) FROM e GROUP BY 1",
    "graph_degree": "WITH " + GRAPH + " SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node",
    "graph_hash": "WITH " + GRAPH + ", " + HASH + " SELECT graph_hash FROM hashed",
    "zero_skill_counts": "WITH " + GRAPH + " SELECT 'resume' AS which, (SELECT count(*) FROM res) AS entities, (SELECT count(*) FROM res WHERE id NOT IN (SELECT id FROM re)) AS without_skills UNION ALL SELECT 'job', (SELECT count(*) FROM job), (SELECT count(*) FROM job WHERE id NOT IN (SELECT id FROM je))",
    "missing_skills_topk": "WITH " + GRAPH + ", " + STORED + " SELECT s.job_id, s.resume_id, s.rank, coalesce((SELECT string_agg(skill, '|' ORDER BY skill) FROM je WHERE je.id = s.job_id AND skill NOT IN (SELECT skill FROM re WHERE re.id = s.resume_id)), '') AS missing_skills FROM stored s WHERE s.job_id IN (SELECT id FROM job) AND s.resume_id IN (SELECT id FROM res)",
    "interactions_union": "WITH " + EDGES + " SELECT job_id, resume_id FROM ia",
    "int_index": "WITH " + EDGES + " SELECT resume_id, row_number() OVER (ORDER BY resume_id) - 1 AS idx FROM (SELECT DISTINCT resume_id FROM ia)",
    "normalized_adjacency": "WITH " + EDGES + " SELECT src, dst, round(w, 6) AS w FROM ad",
    "lightgcn_propagate_2hop": "WITH " + EDGES + ", " + X0 + ", x1 AS (SELECT ad.src AS node, dim, sum(w * x) AS x FROM ad JOIN x0 ON x0.node = ad.dst GROUP BY 1, 2), x2 AS (SELECT ad.src AS node, dim, sum(w * x) AS x FROM ad JOIN x1 ON x1.node = ad.dst GROUP BY 1, 2) SELECT node, dim, round(sum(x) / 3.0, 6) AS x FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) GROUP BY node, dim",
    "sage_mean_aggregate": "WITH " + EDGES + ", " + X0 + " SELECT bd.src AS node, dim, round(avg(x), 6) AS mean FROM bd JOIN x0 ON x0.node = bd.dst GROUP BY 1, 2",
    "negative_pool": "WITH " + EDGES + ", " + NEG.format(draws=16, per=2) + " SELECT job_id, resume_id, draw FROM ng",
    "bpr_loss_fixed_pairs": "WITH " + EDGES + ", " + NEG.format(draws=8, per=1) + f""", t AS (SELECT 'job_' || job_id AS a, 'resume_' || p AS b, 'resume_' || ng.resume_id AS c FROM (SELECT job_id, min(resume_id) AS p FROM ia GROUP BY 1) JOIN ng USING (job_id)),
v AS (SELECT a, b, c, dim, {_seeded('a', 'dim')} AS u, {_seeded('b', 'dim')} AS p, {_seeded('c', 'dim')} AS n FROM t, range(0, 4) r(dim)),
s AS (SELECT sum(u * (p - n)) AS s, sum(u * u + p * p + n * n) AS q FROM v GROUP BY a, b, c)
SELECT round(avg(-(least(s, 0) - ln(1 + exp(-abs(s))))) + 1e-4 * sum(q) / count(*), 6) AS loss FROM s""",
    "cosine_topk_forward": _cosine(True), "cosine_topk_reverse": _cosine(False),
    "html_strip_simple": f"WITH {ENT} SELECT row_num, {_strip('Resume_str')} AS plain FROM resume_clean, ent",
    "html_strip_parser": f"WITH {ENT} SELECT row_num, {_parsed('Resume_str')} AS plain FROM resume_clean, ent",
    "id_repair": "WITH " + REPAIR + " SELECT * FROM rep", "id_repair_summary": "WITH " + REPAIR + " SELECT action, count(*) AS n FROM rep GROUP BY action",
    "jobs_clean": "WITH " + CLEAN + " SELECT k AS job_id, title, d1 AS description, company_id FROM c2 WHERE k = '' OR rn = 1",
    "jobs_clean_counts": "WITH " + CLEAN + " SELECT (SELECT count(*) FROM c1) AS rows_in, (SELECT count(*) FROM c1 WHERE d1 = '') AS dropped_empty, (SELECT count(*) FROM c1 WHERE d1 <> '' AND length(d1) < 40) AS dropped_short, count(*) FILTER (WHERE k <> '' AND rn > 1) AS deduped, count(*) FILTER (WHERE k = '' OR rn = 1) AS rows_out FROM c2",
    "jobs_index": r"SELECT trim(job_id) AS job_id, arg_min(t, row_num) AS title, arg_min(t, row_num) || ' [' || trim(job_id) || ']' AS label FROM (SELECT *, substr(trim(regexp_replace(coalesce(title, ''), '[ \t\n\v\f\r]+', ' ', 'g')), 1, 100) AS t FROM postings_clean) WHERE trim(job_id) <> '' GROUP BY trim(job_id)",
    "metrics_normalised": METRICS + " SELECT * FROM m",
    "metrics_unpivot": METRICS + " SELECT method, 'p' AS metric, p AS value FROM m UNION ALL SELECT method, 'ndcg', ndcg FROM m UNION ALL SELECT method, 'map', map FROM m",
    "overall_pick": METRICS + " SELECT * FROM m WHERE method = 'tfidf'",
    "labelled_missing_resumes": with_(LABELS, RES) + "SELECT DISTINCT resume_id FROM lab WHERE resume_id NOT IN (SELECT id FROM res)",
    "best_per_pair": with_(PAIRS) + "SELECT * FROM prs",
    "first_label_per_pair": "SELECT job_id, resume_id, label FROM labels_clean_top10_strict WHERE job_id IS NOT NULL AND resume_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id, resume_id ORDER BY label_row) = 1",
}

ORACLE |= {
    "filtered_shortlist": "SELECT job_id, resume_id, coalesce(rank, 1000000000) AS rank FROM job_to_resumes_top10_tfidf WHERE resume_id IS NOT NULL AND job_id = (SELECT job_id FROM job_to_resumes_top10_tfidf WHERE job_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, job_id LIMIT 1) ORDER BY 3, 2 LIMIT 10",
    "top_labels": "WITH b AS (SELECT job_id, resume_id, max(coalesce(match_percent, 0.0)) AS match_percent FROM labels_clean_top10_strict WHERE job_id IS NOT NULL AND resume_id IS NOT NULL GROUP BY 1, 2) SELECT *, CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY match_percent DESC, resume_id) <= 10 THEN 1 ELSE 0 END AS y FROM b",
    "ranks_by_order": "SELECT job_id, resume_id, CAST(max(r) AS INTEGER) AS rank FROM (SELECT job_id, resume_id, row_number() OVER (PARTITION BY job_id ORDER BY row_num) AS r FROM job_to_resumes_top10_tfidf WHERE job_id IS NOT NULL AND resume_id IS NOT NULL) GROUP BY 1, 2",
}

_SKILL_LIST = ", ".join(f"('{x}')" for x in SIGNED_SKILLS)
_NODES = "nodes AS (SELECT 'resume' AS which, id FROM res UNION SELECT 'job', id FROM job), noem AS (SELECT which, id FROM nodes WHERE which || '_' || id NOT IN (SELECT src FROM e))"
_TPR = "tp AS (SELECT s.grp, avg(CASE WHEN l.y = 1 THEN s.y_pred END) AS r FROM sel s JOIN lab l USING (job_id, resume_id) GROUP BY 1)"
ORACLE |= {
    # a match must stand on its own as stated in the operator; the leftmost, then longest match goes on where the last one ended
    "skill_matches_signs": rf"""WITH RECURSIVE {JOBS}, sk(s) AS (VALUES {_SKILL_LIST}),
d AS (SELECT id, regexp_replace(regexp_replace(lower(text), '[-_/]', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g') AS t FROM job),
h AS (SELECT id, t, s, unnest(string_split(t, s)) AS piece, generate_subscripts(string_split(t, s), 1) AS i, len(string_split(t, s)) AS n FROM d JOIN sk ON contains(t, s)),
o AS (SELECT id, t, s, i, n, sum(length(piece)) OVER (PARTITION BY id, s ORDER BY i) + (i - 1) * length(s) AS a FROM h),
x AS (SELECT id, s, CAST(a AS BIGINT) AS a, substr(t, CAST(a AS BIGINT), 1) AS l, substr(t, CAST(a AS BIGINT) + length(s) + 1, 1) AS r FROM o WHERE i < n),
m AS (SELECT id, s, a, a + length(s) AS b FROM x WHERE
  CASE WHEN regexp_full_match(s, '[a-z0-9].*[a-z0-9]|[a-z0-9]') THEN NOT (a > 0 AND regexp_full_match(l, '[\p{{L}}\p{{N}}_]')) AND NOT regexp_full_match(r, '[\p{{L}}\p{{N}}_]')
  WHEN regexp_full_match(s, '.*[a-z0-9]') THEN NOT regexp_full_match(r, '[A-Za-z_]') ELSE NOT regexp_full_match(r, '[A-Za-z_]') AND NOT (a > 0 AND regexp_full_match(l, '[\p{{L}}\p{{N}}_]')) END),
w AS (SELECT id, CAST(0 AS BIGINT) AS e, CAST(NULL AS VARCHAR) AS s, CAST(-1 AS BIGINT) AS a FROM d UNION ALL
  SELECT id, b, s, a FROM (SELECT w.id, m.b, m.s, m.a, row_number() OVER (PARTITION BY w.id ORDER BY m.a, m.b DESC) AS k FROM w JOIN m ON m.id = w.id AND m.a >= w.e) WHERE k = 1)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INTEGER) AS place, skill FROM (SELECT id, s AS skill, min(a) AS a FROM w WHERE s IS NOT NULL GROUP BY 1, 2)""",
    "tpr_diff": with_(STORED, POP, LABELS, _sel("stored"), _TPR) + "SELECT round(CASE WHEN count(r) > 1 THEN max(r) - min(r) ELSE 0.0 END, 6) AS tpr_diff FROM (SELECT round(r, 6) AS r FROM tp)",
    "parity_report": "WITH " + _parity(False) + """, fk AS (SELECT count(*) AS jobs, coalesce(sum(CASE WHEN n >= 10 THEN 1 ELSE 0 END), 0) AS f FROM (SELECT job_id, count(*) AS n FROM stored GROUP BY 1)),
su AS (SELECT attribute, coalesce(min(parity_ratio), 1.0) AS r, coalesce(min(parity_diff_pp), 0.0) AS p FROM audit GROUP BY 1),
al AS (SELECT attribute, "group", resume_count, rec_count, parity_ratio, parity_diff_pp, note FROM audit
  UNION ALL SELECT attribute, '__SUMMARY__', NULL, NULL, r, p, 'rule_80_pass=' || CASE WHEN r >= 0.8 THEN 'true' ELSE 'false' END || '; jobs_full_k=' || printf('%.1f', 100.0 * f / jobs) || '% (' || f || '/' || jobs || ')' FROM su, fk)
SELECT *, CAST(row_number() OVER (PARTITION BY attribute ORDER BY resume_count DESC NULLS LAST, "group") AS INTEGER) AS place FROM al""",
    "missing_skills_resume": "WITH " + GRAPH + ", " + PAIRS + ", rk AS (SELECT resume_id, job_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY round(score, 6) DESC, job_id) AS INTEGER) AS rank FROM prs QUALIFY row_number() OVER (PARTITION BY resume_id ORDER BY round(score, 6) DESC, job_id) <= 10) SELECT s.resume_id, s.job_id, s.rank, coalesce((SELECT string_agg(skill, '|' ORDER BY skill) FROM je WHERE je.id = s.job_id AND skill NOT IN (SELECT skill FROM re WHERE re.id = s.resume_id)), '') AS missing_skills FROM rk s WHERE s.job_id IN (SELECT id FROM job) AND s.resume_id IN (SELECT id FROM res)",
    "job_ids_in_ranking": "SELECT DISTINCT trim(job_id) AS job_id FROM job_to_resumes_top10_tfidf WHERE trim(job_id) <> ''",
    "options_in_ranking": "WITH ix AS (" + ORACLE["jobs_index"] + "), " + STORED + " SELECT * FROM ix WHERE job_id IN (SELECT job_id FROM stored)",
    "category_counts": "SELECT Category AS value, count(*) AS n FROM resume_clean GROUP BY 1",
    "corpus_consistency": with_(LABELS, RES, JOBS) + """SELECT 'labelled_jobs' AS name, count(DISTINCT job_id) AS n, count(DISTINCT job_id) > 0 AS ok FROM lab UNION ALL SELECT 'labelled_resumes', count(DISTINCT resume_id), count(DISTINCT resume_id) > 0 FROM lab
UNION ALL SELECT 'missing_resumes', count(DISTINCT resume_id), count(DISTINCT resume_id) = 0 FROM lab WHERE resume_id NOT IN (SELECT id FROM res) UNION ALL SELECT 'missing_jobs', count(DISTINCT job_id), count(DISTINCT job_id) = 0 FROM lab WHERE job_id NOT IN (SELECT id FROM job) UNION ALL SELECT 'resumes', count(*), count(*) >= 10 FROM res""",
    "graph_from_cached_skills": "WITH " + GRAPH + " SELECT 'resume' AS part, count(*) AS n FROM res UNION ALL SELECT 'job', count(*) FROM job UNION ALL SELECT 'skill', count(DISTINCT dst) FROM e UNION ALL SELECT 'edge', count(*) FROM e",
    "no_embedding": "WITH " + GRAPH + ", " + _NODES + " SELECT which, id, 'no_embedding' AS reason FROM noem",
    "run_manifest": "WITH " + GRAPH + ", " + HASH + ", " + _NODES + " SELECT 'nodes' AS name, CAST((SELECT count(*) FROM nodes) + (SELECT count(DISTINCT dst) FROM e) AS VARCHAR) AS value UNION ALL SELECT 'edges', CAST(count(*) AS VARCHAR) FROM e UNION ALL SELECT 'no_embedding', CAST(count(*) AS VARCHAR) FROM noem UNION ALL SELECT 'graph_hash', graph_hash FROM hashed UNION ALL SELECT 'zero_skill_resumes', CAST(count(*) AS VARCHAR) FROM res WHERE id NOT IN (SELECT id FROM re) UNION ALL SELECT 'zero_skill_jobs', CAST(count(*) AS VARCHAR) FROM job WHERE id NOT IN (SELECT id FROM je)",
}
