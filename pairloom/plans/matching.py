"""Queries of the matching operators over the tables, with their SQL.

TF-IDF and BM25 take all rows of one table as queries against all rows of the other; searches by vectors take every row
whose row_num is divisible by 100. Vectors: even vec_ids are jobs, odd ones resumes.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import evaluate, explain, fairness, gnn, graph, lexical, rank, report, text, vectors
from pairloom.session import cut, stored as stored_table, table

ATTRIBUTES = ["Gender", "Ethnicity"]
DIMS = 4
#: Epochs and dimensions of the learning queries; the operators' own defaults are the reference's 50 and 64 (see README).
EPOCHS, LEARNT_DIMS = 2, 16


def resumes(spark, d):
    return lexical.corpus(table(spark, d, "resume_clean"), "ID", "Resume_str")


def jobs(spark, d):
    return lexical.corpus(table(spark, d, "postings_clean"), "job_id", "description")


def query_ids(spark, d, name, key):
    return table(spark, d, name).where("row_num % 100 = 0").select(F.trim(key).alias("id")).where("id <> ''").distinct()


def _sides(spark, d, direction, pattern):
    """The blocks of all queries and of all documents, and the names of their keys."""
    r, j = (("resume_clean", "ID", "Resume_str"), "resume_id"), (("postings_clean", "job_id", "description"), "job_id")
    (q, left), (docs, right) = (j, r) if direction == "job" else (r, j)

    def side(name, key, text):
        t = table(spark, d, name)
        return lexical.blocks(lexical.corpus(t, key, text, parts=lexical.block_count(t, text)), pattern)

    return side(*q), side(*docs), left, right


def lexical_top10(spark, d, method, direction):
    """Every row of one table against every row of the other."""
    best, pattern = (lexical.tfidf_best, lexical.WORDS2) if method == "tfidf" else (lexical.bm25_best, lexical.WORDS1)
    q, docs, left, right = _sides(spark, d, direction, pattern)
    scores = stored_table(best(q, docs))  # used three times
    return lexical.ranking(scores, lexical.block_ids(q), lexical.block_ids(docs), left, right, method)


def idf_table(spark, d):
    docs = resumes(spark, d).withColumn("kind", F.lit("r|")).unionByName(jobs(spark, d).withColumn("kind", F.lit("j|"))).select(F.concat("kind", "id").alias("id"), "text")
    n = docs.count()
    return lexical.smoothed_idf(lexical.document_frequencies(lexical.term_counts(docs)), n).select("token", "df", F.round("idf", 6).alias("idf"))


def bm25_corpus_stats(spark, d):
    return lexical.bm25_stats(resumes(spark, d))


def stored(spark, d):
    """The stored pairs as a ranking: trimmed keys, each pair once with its best score, the first ten of each job."""
    t = table(spark, d, "job_to_resumes_top10_tfidf").select(F.trim("job_id").alias("job_id"), F.trim("resume_id").alias("resume_id"), "score")
    return rank.topk(rank.best_pairs(t, "job_id", "resume_id"), "job_id", "resume_id").select("job_id", "resume_id", "score", "rank")


def other(spark, d):
    """A second ranking of the same pairs: by the least of a pair's scores instead of the best, all spellings of the source alike."""
    t = table(spark, d, "job_to_resumes_top10_tfidf").select(F.trim("job_id").alias("job_id"), F.trim("resume_id").alias("resume_id"), "score").where("job_id IS NOT NULL AND resume_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return rank.topk(t.groupBy("job_id", "resume_id").agg(F.min("score").alias("score")), "job_id", "resume_id").select("job_id", "resume_id", "score", "rank")


def stored_top10(spark, d):
    return stored(spark, d)


def method_overlap_at10(spark, d):
    return rank.overlap_at10(stored(spark, d), other(spark, d))


def consensus_proxy(spark, d):
    return rank.consensus({"stored": stored(spark, d), "least": other(spark, d)})


def coverage_full_k(spark, d):
    return rank.coverage(stored(spark, d))


def shortlist_delta_rank(spark, d):
    return rank.rank_delta(stored(spark, d), other(spark, d))


def labels(spark, d):
    return evaluate.clean_labels(table(spark, d, "labels_clean_top10_strict"))


def evaluation(spark, d, variant):
    return evaluate.evaluate(stored(spark, d), labels(spark, d), variant, "stored")


def label_rules_matrix(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("1", "1.0", "true", "TRUE", "True", "0.6", "0", "yes", "t", "", "-1", "2")], "label string")
    return evaluate.label_matrix(rows, "label")


def population(spark, d):
    return fairness.population(table(spark, d, "resume_clean"), "ID", ATTRIBUTES, "row_num")


def parity_audit(spark, d):
    return fairness.parity(stored(spark, d), population(spark, d), ATTRIBUTES)


def parity_audit_intersection(spark, d):
    return fairness.parity(stored(spark, d), population(spark, d), ATTRIBUTES, intersection=ATTRIBUTES)


def parity_per_job(spark, d):
    return fairness.parity_per_job(stored(spark, d), population(spark, d), ATTRIBUTES)


def parity_summary_rule80(spark, d):
    return fairness.parity_summary(parity_audit(spark, d))


def fairness_weights(spark, d):
    return fairness.group_weights(parity_audit(spark, d))


def fair_rerank_top10(spark, d):
    return fairness.rerank(candidates(spark, d), population(spark, d), fairness_weights(spark, d), ATTRIBUTES)


def candidates(spark, d):
    """All stored pairs with their place by score."""
    t = table(spark, d, "job_to_resumes_top10_tfidf").select(F.trim("job_id").alias("job_id"), F.trim("resume_id").alias("resume_id"), "score")
    return rank.best_pairs(t, "job_id", "resume_id").withColumn("rank", F.lit(1))


def _selection(spark, d, recs):
    return fairness.selection(recs, candidates(spark, d), population(spark, d), ATTRIBUTES)


def selection_rate_audit(spark, d):
    return fairness.selection_rates(_selection(spark, d, stored(spark, d)))


def dp_summary(spark, d):
    return fairness.dp_summary(_selection(spark, d, stored(spark, d)))


def tpr_by_group(spark, d):
    return fairness.true_positive_rates(_selection(spark, d, stored(spark, d)), labels(spark, d))


def fairness_pre_post_merge(spark, d):
    pre = fairness.selection_rates(_selection(spark, d, stored(spark, d)))
    post = fairness.selection_rates(_selection(spark, d, fair_rerank_top10(spark, d)))
    return report.pre_post(pre, post)


def skills(spark, d):
    """The dictionary: the words of six or more letters in the postings' titles."""
    words = table(spark, d, "postings_clean").select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z]{6,}"), F.lit(0))).alias("skill"))
    return words.distinct()


def skill_dictionary(spark, d):
    return skills(spark, d)


def resume_skills(spark, d):
    return text.skill_matches(resumes(spark, d), skills(spark, d))


def job_skills(spark, d):
    return text.skill_matches(jobs(spark, d), skills(spark, d))


def skill_edges(spark, d):
    return resume_skills(spark, d).select(F.col("id").alias("resume_id"), F.explode("skills").alias("skill"))


def _graph(spark, d):
    return graph.skill_graph(resume_skills(spark, d), job_skills(spark, d))


def graph_nodes_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return nodes.groupBy("node_type").agg(F.count("*").alias("n")).unionByName(edges.select(F.concat(F.split("src", "_")[0], F.lit("-skill")).alias("node_type")).groupBy("node_type").agg(F.count("*").alias("n"))).withColumnRenamed("node_type", "part")


def graph_degree(spark, d):
    return graph.degrees(_graph(spark, d)[1])


def graph_hash(spark, d):
    return graph.edge_hash(_graph(spark, d)[1])


def zero_skill_counts(spark, d):
    none = lambda df, w: df.agg(F.count("*").alias("entities"), F.coalesce(F.sum(F.when(F.size("skills") == 0, 1).otherwise(0)), F.lit(0)).alias("without_skills")).select(F.lit(w).alias("which"), "*")
    return none(resume_skills(spark, d), "resume").unionByName(none(job_skills(spark, d), "job"))


def missing_skills_topk(spark, d):
    """Per stored pair of the first ten places, the job's skills that the resume lacks, sorted and joined by bars."""
    top = stored(spark, d).select("job_id", "resume_id", "rank")
    j = top.join(job_skills(spark, d).select(F.col("id").alias("job_id"), F.col("skills").alias("js")), "job_id").join(resume_skills(spark, d).select(F.col("id").alias("resume_id"), F.col("skills").alias("rs")), "resume_id")
    return j.select("job_id", "resume_id", "rank", F.array_join(F.array_sort(F.array_except("js", "rs")), "|").alias("missing_skills"))


def pairs(spark, d):
    return graph.interactions(stored(spark, d), other(spark, d))


def interactions_union(spark, d):
    return pairs(spark, d)


def int_index(spark, d):
    return graph.int_index(pairs(spark, d), "resume_id")


def _edges(spark, d):
    return pairs(spark, d).select(F.concat(F.lit("job_"), "job_id").alias("src"), F.concat(F.lit("resume_"), "resume_id").alias("dst"))


def normalized_adjacency(spark, d):
    return graph.adjacency(_edges(spark, d)).select("src", "dst", F.round("w", 6).alias("w"))


def _x0(spark, d):
    return graph.initial(graph.degrees(_edges(spark, d)), DIMS)


def lightgcn_propagate_2hop(spark, d):
    return graph.propagate(graph.adjacency(_edges(spark, d)), graph.initial_vectors(graph.degrees(_edges(spark, d)), DIMS), DIMS, 2)


def sage_mean_aggregate(spark, d):
    return graph.neighbour_mean(_edges(spark, d), _x0(spark, d))


def negative_pool(spark, d):
    return graph.negatives(pairs(spark, d), pairs(spark, d).select("resume_id"))


def bpr_loss_fixed_pairs(spark, d):
    """The loss of the initial values, with each job's first resume as positive and its seeded negative."""
    pos = pairs(spark, d).groupBy("job_id").agg(F.min("resume_id").alias("p"))
    neg = graph.negatives(pairs(spark, d), pairs(spark, d).select("resume_id"), per_job=1).select("job_id", F.col("resume_id").alias("n"))
    t = pos.join(neg, "job_id").select(F.concat(F.lit("job_"), "job_id").alias("a"), F.concat(F.lit("resume_"), "p").alias("b"), F.concat(F.lit("resume_"), "n").alias("c"))
    vec = lambda c: F.array(*[graph.seeded(F.col(c), F.lit(i)) for i in range(DIMS)])
    return gnn.bpr_loss(t.select(vec("a").alias("u"), vec("b").alias("p"), vec("c").alias("n")))


def _vectors(spark, d, odd, only_queries=False):
    e = table(spark, d, "embeddings").where(f"vec_id % 2 = {int(odd)}" + (f" AND vec_id % 100 = {int(odd)}" if only_queries else ""))
    return e.select(F.col("vec_id").cast("string").alias("resume_id" if odd else "job_id"), F.col("embedding").alias("vec"))


def cosine_topk(spark, d, forward):
    if forward:
        return vectors.cosine_topk(_vectors(spark, d, False, True), _vectors(spark, d, True), "job_id", "resume_id")
    return vectors.cosine_topk(_vectors(spark, d, True, True), _vectors(spark, d, False), "resume_id", "job_id")


def _learnt_topk(spark, d, v, forward=True):
    """The ten nearest of the other side: for jobs (or resumes) that stand in a row whose row_num is divisible by 100."""
    side = lambda p, c: v.where(F.col("node").startswith(p)).select(F.substring("node", len(p) + 1, 200).alias(c), "vec")
    name, key, left, right = ("postings_clean", "job_id", "job", "resume") if forward else ("resume_clean", "ID", "resume", "job")
    q = query_ids(spark, d, name, key).withColumnRenamed("id", f"{left}_id")
    return vectors.cosine_topk(side(f"{left}_", f"{left}_id").join(q, f"{left}_id", "left_semi"), side(f"{right}_", f"{right}_id"), f"{left}_id", f"{right}_id")


_TRAINED: dict[tuple, DataFrame] = {}


def _trained(spark, d, name, make):
    """Node vectors of one method and data folder, trained once per application, since both directions use them."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _TRAINED:
        _TRAINED[key] = stored_table(make())
    return _TRAINED[key]


def node2vec_topk(spark, d, forward=True):
    """By vectors of biased walks over the interaction graph, with the reference's CPU settings."""
    return _learnt_topk(spark, d, _trained(spark, d, "node2vec", lambda: graph.node2vec(_edges(spark, d))), forward)


def lightgcn_topk(spark, d, forward=True):
    """By LightGCN with validation on labelled jobs and early stopping."""
    v = _trained(spark, d, "lightgcn", lambda: gnn.lightgcn(pairs(spark, d), labels(spark, d), dims=LEARNT_DIMS, epochs=EPOCHS)[0])
    return _learnt_topk(spark, d, v, forward).withColumn("source", F.lit("lightgcn"))


def graphsage_topk(spark, d, forward=True):
    """By GraphSAGE with validation on labelled jobs and early stopping."""
    v = _trained(spark, d, "graphsage", lambda: gnn.graphsage(pairs(spark, d), labels(spark, d), dims=LEARNT_DIMS, steps=EPOCHS)[0])
    return _learnt_topk(spark, d, v, forward).withColumn("source", F.lit("graphsage"))


def _surrogate(spark, d):
    f = explain.pair_features(labels(spark, d), stored(spark, d), other(spark, d), resumes(spark, d), jobs(spark, d))
    return explain.surrogate(cut(f.where("y IS NOT NULL")))


def surrogate_shap_global(spark, d):
    return _surrogate(spark, d)[1]


def surrogate_shap_pairs(spark, d):
    return _surrogate(spark, d)[0]


def surrogate_shap_job(spark, d):
    """The features of the job with most labelled pairs."""
    p = cut(_surrogate(spark, d)[0])
    most = p.groupBy("job_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "job_id").first()
    return report.shap_of_job(p, most[0] if most else "")


def html_strip_simple(spark, d):
    return table(spark, d, "resume_clean").select("row_num", text.strip_html_simple(F.col("Resume_str")).alias("plain"))


def html_strip_parser(spark, d):
    return table(spark, d, "resume_clean").select("row_num", text.strip_html_parser(F.col("Resume_str")).alias("plain"))


def id_repair(spark, d):
    return text.repair_ids(table(spark, d, "resume_clean"), "ID", "row_num", "Resume_str", ["ID", "Resume_str", "Category"])


def id_repair_summary(spark, d):
    return id_repair(spark, d).groupBy("action").agg(F.count("*").alias("n"))


def jobs_clean(spark, d):
    return text.clean_jobs(table(spark, d, "postings_clean"), keep=("job_id", "title", "description", "company_id"))


def jobs_clean_counts(spark, d):
    return text.job_cleaning_counts(table(spark, d, "postings_clean"))


def jobs_index(spark, d):
    return report.jobs_index(table(spark, d, "postings_clean"))


def _metrics(spark, d):
    a = evaluate.evaluate(stored(spark, d), labels(spark, d), "all", "tfidf")
    b = evaluate.evaluate(other(spark, d), labels(spark, d), "all", "default")
    return report.normalised_metrics(a.unionByName(b))


def metrics_normalised(spark, d):
    return _metrics(spark, d)


def metrics_unpivot(spark, d):
    return report.unpivoted(_metrics(spark, d))


def overall_pick(spark, d):
    return report.pick(_metrics(spark, d))


def labelled_missing_resumes(spark, d):
    """Labelled resumes that the corpus lacks."""
    return labels(spark, d).select("resume_id").distinct().join(resumes(spark, d).select(F.col("id").alias("resume_id")), "resume_id", "left_anti")


def best_per_pair(spark, d):
    t = table(spark, d, "job_to_resumes_top10_tfidf").select(F.trim("job_id").alias("job_id"), F.trim("resume_id").alias("resume_id"), "score")
    return rank.best_pairs(t, "job_id", "resume_id")


def first_label_per_pair(spark, d):
    t = table(spark, d, "labels_clean_top10_strict").select("job_id", "resume_id", "label", "label_row")
    return rank.first_rows(t, ["job_id", "resume_id"], ["label_row"]).select("job_id", "resume_id", "label")


def _named(name, f, *a):
    g = partial(lambda spark, d, a=a, f=f: f(spark, d, *a))
    g.__name__ = name
    return name, g


QUERIES = dict(
    [_named(f"{m}_{s}_top10", lexical_top10, m, k) for m in ("tfidf", "bm25") for s, k in (("job_to_resumes", "job"), ("resume_to_jobs", "resume"))]
    + [("tfidf_idf_table", idf_table)]
    + [_named(f"eval_{n}", evaluation, v) for n, v in (("labelled_jobs", "labelled"), ("all_jobs_pooled", "all"), ("total_positives", "positives"))]
    + [_named("precision_at_k", evaluation, "precision"), _named("cosine_topk_forward", cosine_topk, True), _named("cosine_topk_reverse", cosine_topk, False)]
    + [(f.__name__, f) for f in (
        bm25_corpus_stats, stored_top10, method_overlap_at10, consensus_proxy, coverage_full_k, shortlist_delta_rank, label_rules_matrix, parity_audit, parity_audit_intersection, parity_per_job, parity_summary_rule80, fairness_weights, fair_rerank_top10, selection_rate_audit, dp_summary,
        tpr_by_group, fairness_pre_post_merge, skill_dictionary, skill_edges, graph_nodes_edges, graph_degree, graph_hash, zero_skill_counts, missing_skills_topk, interactions_union, int_index, normalized_adjacency, lightgcn_propagate_2hop, sage_mean_aggregate, negative_pool, bpr_loss_fixed_pairs,
        node2vec_topk, lightgcn_topk, graphsage_topk, surrogate_shap_global, surrogate_shap_pairs, html_strip_simple, html_strip_parser, id_repair, id_repair_summary, jobs_clean, jobs_clean_counts, jobs_index, metrics_normalised, metrics_unpivot, overall_pick, labelled_missing_resumes, best_per_pair, first_label_per_pair)]
)


def filtered_shortlist(spark, d):
    """The shortlist of the job with most stored rows."""
    from pairloom.sources import scans

    t = table(spark, d, "job_to_resumes_top10_tfidf")
    most = t.where("job_id IS NOT NULL").groupBy("job_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "job_id").first()
    return scans.one_job(t.where("resume_id IS NOT NULL").select("job_id", "resume_id", "score", "rank"), most[0] if most else "").select("job_id", "resume_id", "rank")


def top_labels(spark, d):
    from pairloom.sources import scans

    return scans.top_labels(table(spark, d, "labels_clean_top10_strict"))


def ranks_by_order(spark, d):
    from pairloom.sources import scans

    return scans.ranks_by_order(table(spark, d, "job_to_resumes_top10_tfidf"), "row_num")


QUERIES |= {f.__name__: f for f in (filtered_shortlist, top_labels, ranks_by_order)}


# A dictionary of skills with several words and with signs.
SKILLS = ("c", "c++", "c#", "r", "go", ".net", "asp.net", "node.js", "java", "javascript", "python", "sql", "machine learning", "mechanical engineering", "graphic design", "food science", "engineering", "data entry", "price list", "price list ideas", "lesson plan", "shift plan", "stock count", "sensor array", "ticket queue", "customer service", "project management", "power shell", "autocad", "excel", "sap", "jira", "linux", "docker", "kafka", "spark", "tableau", "matlab", "git", "on call duty", "call", "award winning")


def skill_matches_signs(spark, d):
    """The matches of a dictionary with signs and several words in the postings, in order of place."""
    dictionary = spark.createDataFrame([(x,) for x in SKILLS], "skill string")
    return text.skill_matches(jobs(spark, d), dictionary).select("id", F.posexplode("skills").alias("place", "skill"))


def tpr_diff(spark, d):
    return fairness.tpr_difference(tpr_by_group(spark, d))


def parity_report(spark, d):
    return fairness.parity_report(parity_audit(spark, d), stored(spark, d))


def missing_skills_resume(spark, d):
    """Per resume its ten best jobs among the stored pairs, with the job's skills that it lacks."""
    top = rank.topk(candidates(spark, d).select("job_id", "resume_id", "score"), "resume_id", "job_id")
    j = top.join(job_skills(spark, d).select(F.col("id").alias("job_id"), F.col("skills").alias("js")), "job_id").join(resume_skills(spark, d).select(F.col("id").alias("resume_id"), F.col("skills").alias("rs")), "resume_id")
    return j.select("resume_id", "job_id", "rank", F.array_join(F.array_sort(F.array_except("js", "rs")), "|").alias("missing_skills"))


def job_ids_in_ranking(spark, d):
    return report.job_ids_in_ranking(table(spark, d, "job_to_resumes_top10_tfidf"))


def options_in_ranking(spark, d):
    return report.options_in_ranking(jobs_index(spark, d), stored(spark, d))


def category_counts(spark, d):
    return report.value_counts(table(spark, d, "resume_clean"), "Category")


def corpus_consistency(spark, d):
    return report.consistency(jobs(spark, d), resumes(spark, d), labels(spark, d))


def graph_from_cached_skills(spark, d):
    """Node and edge counts of the graph rebuilt from stored skill maps."""
    r, j = stored_table(resume_skills(spark, d)), stored_table(job_skills(spark, d))
    nodes, edges = graph.graph_of_cached(resumes(spark, d), jobs(spark, d), r.where("size(skills) > 0"), j.where("size(skills) > 0"))
    return nodes.groupBy("node_type").agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("node_type")).agg(F.count("*").alias("n"))).withColumnRenamed("node_type", "part")


def no_embedding(spark, d):
    """Resumes and jobs without a vector: those without any edge of the skill graph."""
    nodes, edges = _graph(spark, d)
    return graph.without_embeddings(nodes, edges.select(F.col("src").alias("node")))


def run_manifest(spark, d):
    """The facts of a run as (name, value)."""
    nodes, edges = _graph(spark, d)
    one = lambda name, df: df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("string").alias("value"))
    n = F.count("*").alias("n")
    zero = zero_skill_counts(spark, d)
    parts = [one("nodes", nodes.agg(n)), one("edges", edges.agg(n)), one("no_embedding", no_embedding(spark, d).agg(n)), one("graph_hash", graph.edge_hash(edges)), *[one(f"zero_skill_{w}s", zero.where(f"which = '{w}'").select("without_skills")) for w in ("resume", "job")]]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


QUERIES |= {f.__name__: f for f in (skill_matches_signs, tpr_diff, parity_report, missing_skills_resume, job_ids_in_ranking, options_in_ranking, category_counts, corpus_consistency, graph_from_cached_skills, no_embedding, run_manifest, surrogate_shap_job)}
QUERIES |= dict(_named(f"{f.__name__.removesuffix('_topk')}_resume_to_jobs_topk", f, False) for f in (node2vec_topk, lightgcn_topk, graphsage_topk))
