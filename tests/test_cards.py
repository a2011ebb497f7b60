"""Hand-computed cases of the matching operators, one per rule and trap, with empty, null and repeated rows."""

import math
import os

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate, fairness, gnn, graph, lexical, rank, report, text, vectors
from pairloom.sources import csv as source

REC = "job_id string, resume_id string, score double, rank int"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_ties_order_ids_as_strings(spark):
    df = spark.createDataFrame([("j", "2", 0.5), ("j", "10", 0.5), ("j", "1", 0.5000000001), (None, "3", 1.0), ("j", None, 1.0), ("j", "9", None)], "job_id string, resume_id string, score double").withColumn("rank", F.lit("clash"))
    assert rows(rank.topk(df, "job_id", "resume_id", k=10), "rank", "resume_id") == [(1, "1"), (2, "10"), (3, "2"), (4, "9")]
    assert rank.topk(df.limit(0), "job_id", "resume_id").count() == 0


def test_bm25_counts_query_repeats_and_ranks_zeros(spark):
    docs = spark.createDataFrame([("d1", "a b"), ("d2", "a a a"), ("d3", "c"), ("d4", "")], "id string, text string")
    q = spark.createDataFrame([("q", "a a b")], "id string, text string")
    got = {r.doc: r.score for r in lexical.bm25_scores(q, docs).collect()}
    n, avgdl = 4, 6 / 4
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda f, dl: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got["d1"] == pytest.approx(2 * idf(2) * part(1, 2) + idf(1) * part(1, 2)) and got["d2"] == pytest.approx(2 * idf(2) * part(3, 3))
    ranked = lexical.ranking(lexical.bm25_scores(q, docs), q, docs, "job_id", "resume_id", "bm25")
    assert [r.resume_id for r in ranked.orderBy("rank").collect()][-2:] == ["d3", "d4"]


def test_tfidf_smoothed_and_filled(spark):
    r = spark.createDataFrame([("r1", "alpha beta x"), ("r2", "gamma")], "id string, text string")
    j = spark.createDataFrame([("j1", "alpha"), ("j2", "delta y")], "id string, text string")
    every = r.withColumn("kind", F.lit("r")).unionByName(j.withColumn("kind", F.lit("j")))
    out = rows(lexical.ranking(lexical.tfidf_scores(j, r, every), j, r, "job_id", "resume_id", "tfidf"), "job_id", "rank", "resume_id", "score")
    ia, ib = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    assert out == [("j1", 1, "r1", round(ia / math.hypot(ia, ib), 6)), ("j1", 2, "r2", 0.0), ("j2", 1, "r1", 0.0), ("j2", 2, "r2", 0.0)]


def test_evaluation_families(spark):
    recs = [("A", f"r{i}", 0.0, i) for i in range(1, 11)] + [("B", f"b{i}", 0.0, i) for i in range(1, 11)] + [("C", f"c{i}", 0.0, i) for i in range(1, 11)] + [("D", f"d{i}", 0.0, i) for i in range(1, 5)]
    lab = [("A", "r1", 1), ("A", "r3", 1), ("A", "zz", 1), ("A", "r2", 0), ("B", "b1", 0), ("D", "d1", 1)]
    r, y = spark.createDataFrame(recs, REC), spark.createDataFrame(lab, "job_id string, resume_id string, y int")
    got = {v: evaluate.evaluate(r, y, v, "s").first() for v in ("labelled", "all", "positives", "precision")}
    a = 1.5 / (1 + 1 / math.log2(3))  # job A's nDCG from the hits found
    assert (got["labelled"].p_at_k, got["labelled"].ndcg_at_k, got["labelled"].map_at_k) == (0.1, round((a + 0 + 1) / 3, 6), 0.611111)
    assert (got["all"].p_at_k, got["all"].ndcg_at_k, got["all"].map_at_k) == (0.075, 0.539848, 0.458333)
    assert (got["positives"].ndcg_at_k, got["positives"].map_at_k) == (0.42598, 0.388889) and got["precision"].p_at_k == 0.075
    assert evaluate.evaluate(r.limit(0), y, "labelled", "s").first().jobs_scored == 0


def test_labels_last_wins_and_null_is_unknown(spark):
    df = spark.createDataFrame([(1, "j", "r", 1), (2, " j", "r\t", 0), (3, "j", "s", None), (4, " ", "s", 1), (5, None, "s", 1)], "label_row long, job_id string, resume_id string, label int")
    assert rows(evaluate.clean_labels(df), "job_id", "resume_id", "y") == [("j", "r", 0)]


def test_parity_with_short_lists_and_unknown_resumes(spark):
    pop = [(f"f{i}", "F") for i in range(60)] + [(f"m{i}", " m") for i in range(40)] + [(f"x{i}", v) for i, v in enumerate(["", None, " "])] + [("f0", "F")]
    people = fairness.population(spark.createDataFrame([(i, *p) for i, p in enumerate(pop)], "n long, ID string, g string"), "ID", ["g"], "n")
    recs = spark.createDataFrame([("1", "f1", 0.9, 1), ("1", "f1", 0.8, 2), ("1", "m1", 0.7, 3), ("1", "unknown", 0.6, 4), ("2", "f2", 0.9, 1), ("2", "x1", 0.5, 2)], REC)
    got = {r.group: r for r in fairness.parity(recs, people, ["g"], k=3).collect()}
    assert {k: (v.resume_count, v.rec_count, v.total_selected) for k, v in got.items()} == {"f": (60, 2, 6), "m": (40, 1, 6), "missing": (3, 1, 6)}
    assert got["missing"].parity_ratio is None and got["missing"].note == "low_support"
    assert got["f"].parity_ratio == round((2 / 6) / (60 / 103), 6) and 0 <= got["f"].share_selected_lo <= 2 / 6 <= got["f"].share_selected_hi <= 1
    s = fairness.parity_summary(fairness.parity(recs, people, ["g"], k=3)).first()
    assert s.worst_ratio == got["m"].parity_ratio and not s.rule_80_pass


def test_weights_shrink_clip_and_mean(spark):
    audit = spark.createDataFrame([("g", "A", 0.5, 0.8, 6), ("g", "B", 0.5, 0.2, 6), ("h", "Z", 0.0, 0.0, 6), ("", "q", 0.5, 0.5, 6)], "attribute string, `group` string, share_selected double, base_share double, total_selected long")
    assert rows(fairness.group_weights(audit), "attribute", "group", "weight") == [("g", "a", 1.170732), ("g", "b", 0.829268), ("h", "z", 1.0)]


def test_rerank_first_row_and_default_weight(spark):
    recs = spark.createDataFrame([("j", "r1", 0.2, 1), ("j", "r1", 0.9, 2), ("j", "r2", 0.5, 3), ("j", "nobody", 0.3, 4)], REC)
    pop = spark.createDataFrame([("r1", "a"), ("r2", "b")], "resume_id string, g string")
    w = spark.createDataFrame([("g", "b", 1.2)], "attribute string, `group` string, weight double")
    assert rows(fairness.rerank(recs, pop, w, ["g"]), "rank", "resume_id", "score") == [(1, "r2", 0.6), (2, "nobody", 0.3), (3, "r1", 0.2)]


def test_selection_rates_need_a_pool(spark):
    sel = spark.createDataFrame([("j", "a", 1.0, 1), ("j", "b", 0.9, 2)], REC)
    pop = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Y")], "resume_id string, g string")
    own = fairness.selection(sel, sel, pop, ["g"])
    assert {r.selection_rate for r in fairness.selection_rates(own).collect()} == {1.0}
    wide = fairness.selection(sel, spark.createDataFrame([("j", "c"), ("j", "zz")], "job_id string, resume_id string"), pop, ["g"])
    assert rows(fairness.selection_rates(wide), "group", "count", "selection_rate") == [("g=X", 1, 1.0), ("g=Y", 2, 0.5), ("unknown", 1, 0.0)]
    assert fairness.dp_summary(wide).first().dp_difference == 1.0
    y = spark.createDataFrame([("j", "a", 1), ("j", "b", 0)], "job_id string, resume_id string, y int")
    assert rows(fairness.true_positive_rates(wide, y), "group", "count_labelled", "tpr") == [("g=X", 1, 1.0), ("g=Y", 1, None)]


def test_skills_leftmost_longest(spark):
    d = spark.createDataFrame([("c",), ("c++",), (".net",), ("java",), ("java script",), ("object-oriented",), (" JAVA ",), (None,)], "s string")
    docs = spark.createDataFrame([("1", "C++17, ASP.NET, java script, object-oriented"), ("2", "C and Java/java_ee; cc"), ("3", None), ("3", "")], "id string, text string").withColumn("skills", F.lit("clash"))
    got = [(r.id, list(r.skills)) for r in text.skill_matches(docs, d).collect()]
    assert sorted(got) == [("1", ["c++", ".net", "java script"]), ("2", ["c", "java"]), ("3", []), ("3", [])]
    assert all(not r.skills for r in text.skill_matches(docs, d.limit(0)).collect())


def test_html_forms(spark):
    cells = ["a<b>c</b>", "<p>a</p><p>b</p>", "&lt;i&gt;x", "<script>s</script>y", "a<!--c-->b", None, ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    simple = [r.x for r in df.select("i", text.strip_html_simple(F.col("c")).alias("x")).orderBy("i").collect()]
    assert simple == ["a c", "a b", "x", "s y", "a b", None, ""]
    assert [text.html_to_text(c) for c in cells] == ["ac", "a b", "x", "y", "ab", None, ""]


def test_id_repair(spark):
    df = spark.createDataFrame([(1, "abc123", "t"), (2, "", "row 7654321 here"), (3, "<div>1895824384</div>", ""), (4, "x!", "no digits"), (5, "abc123", "t"), (6, None, None), (7, "abc123", "t")], "n long, ID string, txt string")
    got = {r.row_index: r for r in text.repair_ids(df, "ID", "n", "txt", ["ID", "txt"]).collect()}
    assert [got[i].action for i in range(2, 9)] == ["kept", "repaired", "repaired", "synth", "kept", "synth", "kept"]
    assert got[2].new_id == "abc123" and got[3].new_id == "7654321" and got[4].new_id == "1895824384" and got[5].new_id.startswith("syn_") and got[5].new_id.endswith("_5")
    assert got[6].new_id.startswith("abc123_") and len({r.new_id for r in got.values()}) == 7


def test_job_cleaning_order(spark):
    long_ = "x" * 60
    df = spark.createDataFrame([(1, "7", "short", None), (2, "7", long_, "skill"), (3, "7", long_ + "late", None), (4, "", long_, None), (5, None, long_, None), (6, "8", None, None), (7, "9", "<b>" + long_ + "</b>&amp;", "")], "row_num long, job_id string, description string, skills_desc string")
    out = rows(text.clean_jobs(df, keep=("job_id", "description")), "job_id", "description")
    assert out == sorted([("7", long_ + " skill"), ("", long_), ("", long_), ("9", long_ + "&")], key=str)
    c = text.job_cleaning_counts(df).first()
    assert (c.rows_in, c.dropped_empty, c.dropped_short, c.deduped, c.rows_out) == (7, 1, 1, 1, 4)


def test_csv_dialects(spark, tmp_path):
    want = [("1", "a\nb", ""), ("2", 'q "x"', "c")]
    for name, body in {
        "bom": '﻿ID,T,C\r\n1,"a\nb"\r\n2,"q ""x""",c,extra\r\n', "semi": 'sep=;\nID;T;C\n1;"a\nb"\n2;"q ""x""";c\n', "tab": 'sep=\\t\nID\tT\tC\n1\t"a\nb"\n2\t"q ""x"""\tc\n', "bar": 'ID|T|C\n1|"a\nb"\n2|"q ""x"""|c\n',
    }.items():
        p = tmp_path / f"{name}.csv"
        p.write_text(body, encoding="utf-8")
        assert rows(source.read_table(spark, str(p)), "ID", "T", "C") == want, name
    p = tmp_path / "all.csv"
    p.write_text('ID,T,C\n1,a,b\nID,T,C\n2,c,d,e,f\n3,it is 5" wide,x\n4,"q"tail,y\n\n5,"open\nrest,1\n6,z,z\n')
    good, bad = source.read_with_rejects(spark, str(p), key="ID")
    assert rows(good, "_row_index", "ID", "T", "C", "_surplus") == [(0, "1", "a", "b", []), (1, "ID", "T", "C", []), (2, "2", "c", "d", ["e", "f"]), (3, "3", 'it is 5" wide', "x", []), (4, "4", "qtail", "y", [])]
    assert rows(bad, "which", "row_index", "id_if_any", "reason") == [("all.csv", 6, "5", "unclosed quote")]
    good, bad = source.read_with_rejects(spark, str(tmp_path / "nowhere.csv"))
    assert good.count() == 0 and bad.count() == 1
    (tmp_path / "r.csv").write_text("job_id,resume_id,score,similarity,rank\n1,2,,0.5,x\n1,,1,1,1\n 3 ,4,bad,0.9,2\n")
    assert rows(source.read_ranking(spark, str(tmp_path / "r.csv")), "job_id", "resume_id", "score", "rank") == [("1", "2", 0.5, rank.BAD_RANK), ("3", "4", 0.0, 2)]
    (tmp_path / "s.txt").write_text("Element Name\tx\nJava \t1\njava\t2\n")
    (tmp_path / "rel.csv").write_text("skill,related_a,related_b\nX,Go,\n")
    assert rows(source.skill_dictionary(spark, [(str(tmp_path / "s.txt"), ["Example", "Element Name"]), (str(tmp_path / "rel.csv"), ["related*", "skill"])]), "skill") == [("go",), ("java",), ("x",)]


def test_csv_of_many_blocks_equals_a_plain_reader(spark, tmp_path):
    """Records with quoted line breaks, read in blocks of a few bytes, against Python's reader."""
    import csv as plain
    import random

    rng = random.Random(5)
    want = [[str(i), "".join(rng.choice(['a', ',', '"', "\n", "é", " "]) for _ in range(rng.randint(0, 40))), rng.choice(["", "x", '"'])] for i in range(400)]
    with open(tmp_path / "big.csv", "w", newline="", encoding="utf-8") as f:
        plain.writer(f, lineterminator="\n").writerows([["ID", "T", "C"], *want])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        good, bad = source.read_with_rejects(spark, str(tmp_path / "big.csv"))
        got = sorted(((r["_row_index"], [r.ID, r.T, r.C]) for r in good.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(want)) and bad.count() == 0


def test_detection_of_dialects():
    assert source.detect([]) == (",", False) and source.detect(["plain"]) == (",", False) and source.detect(["sep=\\t"]) == ("\t", True) and source.detect(["sep=|"]) == ("|", True)
    assert source.detect(['a;b;c', '1;"x,y,z";2', '3;"p', 'q";4']) == (";", False) and source.detect(["a,b|c", "1,2|3|4"]) == (",", False)
    assert source.parse_header('"a ""b""",c , c,', ",") == ['a "b"', "c", "c_2", ""]


def test_manifest(spark, tmp_path):
    import hashlib
    import json

    (tmp_path / "in.txt").write_text("abc")
    source.write_manifest(spark, str(tmp_path / "m"), spark.createDataFrame([("nodes", 3)], "name string, value int"), [str(tmp_path / "in.txt")], top_k=10)
    made = json.loads(next((tmp_path / "m").glob("*.json")).read_text())
    assert made["facts"] == {"nodes": "3", "top_k": "10"} and made["inputs"] == [{"file": "in.txt", "bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}] and made["written_at"].endswith("Z")


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q", b\nc', 0.123456789, None)], "id string, t string, s double, n string")
    source.write_csv(df.coalesce(1), str(tmp_path / "out"))
    part = next(p for p in os.listdir(tmp_path / "out") if p.endswith(".csv"))
    assert rows(source.read_table(spark, str(tmp_path / "out" / part), ","), "id", "t", "s", "n") == [("1", 'a "q", b\nc', "0.123457", "")]
    source.write_by_source(spark.createDataFrame([("a", 1), ("b", 1)], "source string, v int"), str(tmp_path / "m"))
    source.write_by_source(spark.createDataFrame([("a", 2)], "source string, v int"), str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m")), "source", "v") == [("a", 2), ("b", 1)]


def test_graph_basics(spark):
    r = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"]), ("3", [])], "id string, skills array<string>")
    j = spark.createDataFrame([("9", ["b"])], "id string, skills array<string>")
    nodes, edges = graph.skill_graph(r, j)
    assert nodes.count() == 6 and edges.count() == 4 and nodes.where("node = 'resume_3'").count() == 1
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).repartition(3)
    assert graph.edge_hash(edges).first() == graph.edge_hash(flipped).first()
    assert rows(graph.degrees(edges), "node", "degree") == [("job_9", 1), ("resume_1", 2), ("resume_2", 1), ("skill_a", 2), ("skill_b", 2)]
    assert rows(graph.int_index(nodes, "node", parts=3), "idx") == [(i,) for i in range(6)]
    ids = {x.node: x.idx for x in graph.int_index(nodes, "node", parts=3).collect()}
    assert sorted(ids, key=ids.get) == sorted(ids)


def test_propagation_keeps_root_degrees(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "y")], "src string, dst string")
    d = graph.degrees(edges)
    x0 = d.select("node", F.array(F.sqrt("degree")).alias("vec"))
    got = {r.node: r.x for r in graph.propagate(graph.adjacency(edges), x0, 1, 3).collect()}
    hubs = {r.node: round(r.vec[0], 6) for r in graph.propagated(graph.adjacency(edges), x0, 1, 3, small=False).collect()}
    assert hubs == got == {r.node: round(math.sqrt(r.degree), 6) for r in d.collect()}


@pytest.mark.parametrize("pq", [(1.0, 1.0), (0.5, 2.0)])
def test_walk_steps_are_edges(spark, pq):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    known = {*e, *((y, x) for x, y in e)}
    w = graph.walks(spark.createDataFrame(e, "src string, dst string"), length=6, per_node=3, p=pq[0], q=pq[1]).collect()
    assert len(w) == 12 and all(len(x.path) == 6 and all(s in known for s in zip(x.path, x.path[1:])) for x in w)


def test_negatives_are_not_linked(spark):
    pos = spark.createDataFrame([("j", f"r{i}") for i in range(5)] + [("k", "r0")], "job_id string, resume_id string")
    neg = graph.negatives(pos, pos.select("resume_id"), per_job=3).collect()
    assert {n.job_id for n in neg} == {"k"} and len(neg) == 3 and all(n.resume_id != "r0" for n in neg)


def test_lightgcn_lowers_the_loss(spark):
    pos = spark.createDataFrame([(f"j{i}", f"r{k}") for i in range(6) for k in range(6) if i % 2 == k % 2], "job_id string, resume_id string")
    x, losses = gnn.lightgcn(pos, dims=4, hops=2, epochs=3, rate=0.1)
    assert x.count() == 12 and losses[-1] < losses[0]


def test_training_stops_early_with_the_best_state(spark):
    pos = spark.createDataFrame([(f"j{i}", f"r{k}") for i in range(4) for k in range(6) if i % 2 == k % 2], "job_id string, resume_id string")
    lab = pos.withColumn("y", F.lit(1)).unionByName(spark.createDataFrame([("j0", "r1", 0), ("j9", "r0", 1)], "job_id string, resume_id string, y int"))
    _, losses = gnn.lightgcn(pos, lab, dims=4, hops=1, epochs=9, rate=0.0, every=1, patience=2)
    assert len(losses) == 2  # the first value, then two without gain
    x, losses = gnn.graphsage(pos, lab, dims=4, steps=9, rate=0.0, every=1, patience=1)
    assert len(losses) == 2 and x.count() == 10
    s = gnn.Stopper(2)
    assert [s.done(v, v) for v in (1.0, 2.0, 1.5, 2.0)] == [False, False, False, True] and s.state == 2.0


def test_validation_against_brute_force(spark):
    x = spark.createDataFrame([("job_1", [1.0, 0.0]), ("resume_a", [1.0, 0.1]), ("resume_b", [0.5, 0.5]), ("resume_c", [0.0, 1.0])], "node string, vec array<double>")
    val = spark.createDataFrame([("1", "a", 0), ("1", "b", 1), ("1", "c", 1), ("2", "a", 1)], "job_id string, resume_id string, y int")
    assert gnn.validate(x, val) == pytest.approx((1 / 2 + 2 / 3) / 2) and gnn.validate(x, val.limit(0)) == 0.0


def test_every_positive_has_its_own_negative(spark):
    pos = spark.createDataFrame([("j", "r1"), ("j", "r2"), ("k", "r3")], "job_id string, resume_id string")
    index = graph.int_index(spark.createDataFrame([(f"r{i}",) for i in range(40)], "resume_id string"), "resume_id")
    t = gnn.triples_of(pos, index, 40, 100, 1).collect()
    assert len(t) == 3 and len({r.n for r in t}) > 1 and not any((r.u[4:], r.n[7:]) in {("j", "r1"), ("j", "r2"), ("k", "r3")} for r in t)


def test_missing_parts_and_cached_graphs(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    sk = spark.createDataFrame([("1", ["a"]), ("1", ["a"])], "id string, skills array<string>")
    nodes, edges = graph.graph_of_cached(ids("1", "2", None), ids("9"), sk, sk.limit(0))
    assert rows(nodes, "node") == [("job_9",), ("resume_1",), ("resume_2",), ("skill_a",)] and edges.count() == 1
    assert rows(graph.without_embeddings(nodes, edges.select(F.col("src").alias("node"))), "which", "id") == [("job", "9"), ("resume", "2")]
    pairs = spark.createDataFrame([("j", "r", "f", 0.5), ("j", "s", "f", -0.25), ("k", "r", "f", 9.0)], "job_id string, resume_id string, feature string, shap double")
    assert rows(report.shap_of_job(pairs, "j"), "feature", "mean_abs_shap") == [("f", 0.375)] and rows(report.shap_of_pair(pairs, "j", "s"), "shap") == [(-0.25,)]
    assert fairness.tpr_difference(spark.createDataFrame([("a", 0.5), ("b", None)], "`group` string, tpr double")).first().tpr_diff == 0.0


def test_frequent_keys_are_joined_apart(spark):
    from pairloom.session import frequent_join

    fact = spark.createDataFrame([("hot", i) for i in range(50)] + [("x" * 300, 1), ("y", 2), (None, 3), ("none", 4)], "k string, v int")
    side = spark.createDataFrame([("hot", 50, "a"), ("x" * 300, 1, "b"), ("y", 1, "c"), ("unused", 0, "d")], "k string, n long, w string")
    want = rows(fact.join(side, "k"), "k", "v", "w")
    assert rows(frequent_join(fact, side, "k", "n", rows=0, frequent=1), "k", "v", "w") == want == rows(frequent_join(fact, side, "k", "n"), "k", "v", "w")


def test_html_in_the_parser_form():
    t = text.html_to_text
    assert t("a<hr>b") == "a b" and t("a<table>b") == "ab" and t("x<b>y</b>z &amp;amp; q") == "xyz & q" and t(None) is None and t("") == ""
    assert t("a<script>p<p>q</script>b") == "ab" and t("<style>x</style>y<!-- c -->z</script>w") == "yzw" and t("&lt;div&gt;a&lt;/div&gt;b") == "a b"
    assert t("<template>a<p>b</template>c<noscript>d</noscript>") == "c"


def test_character_references(spark):
    cases = ["&nbsp;x", "&eacute;&#233;&#xE9;&#x1F600;", "a & b &unknown; &amp;lt;", "&#0;", None, "&", "&;", "&CounterClockwiseContourIntegral;"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", text.unescaped(F.col("t")).alias("u"))
    assert [r.u for r in df.orderBy("i").collect()] == ["\xa0x", "ééé😀", "a & b &unknown; &lt;", "\ufffd", None, "&", "&;", "∳"]


def test_bpr_and_vectors(spark):
    t = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0])], "u array<double>, p array<double>, n array<double>")
    assert gnn.bpr_loss(t).first().loss == round(math.log(1 + math.exp(-1)) + 1e-4 * 3, 6)
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "a string, vec array<double>")
    r = spark.createDataFrame([("r2", [2.0, 0.0]), ("r10", [3.0, 0.0]), ("r3", [0.0, 5.0]), ("r4", None)], "b string, vec array<double>")
    assert rows(vectors.cosine_topk(q, r, "a", "b", k=2), "a", "rank", "b", "score") == [("q", 1, "r10", 1.0), ("q", 2, "r2", 1.0), ("z", 1, "r10", 0.0), ("z", 2, "r2", 0.0)]
    assert vectors.cosine_topk(q.limit(0), r, "a", "b").count() == 0 and vectors.cosine_topk(q, r.limit(0), "a", "b").count() == 0


def test_reports(spark):
    m = report.normalised_metrics(spark.createDataFrame([("bm25", 0.1, 0.2, 3), ("tfidf", 0.3, None, 4), ("x", None, None, 1)], "Source string, `P@10` double, `nDCG@10` double, jobs_scored int"))
    assert rows(m, "method", "p", "ndcg", "map", "jobs_scored") == [("bm25", 0.1, 0.2, None, 3), ("tfidf", 0.3, None, None, 4)]
    assert report.pick(m).first().method == "tfidf" and report.pick(m.where("method = 'bm25'")).first().method == "bm25"
    assert report.unpivoted(m).count() == 6
    a, b = spark.createDataFrame([("g", 0.5)], "`group` string, selection_rate double"), spark.createDataFrame([("h", 0.25)], "`group` string, selection_rate double")
    assert rows(report.pre_post(a, b), "group", "stage", "selection_rate") == [("g", "post", 0.0), ("g", "pre", 0.5), ("h", "post", 0.25), ("h", "pre", 0.0)]
    assert report.resolve(m, ["nope", "METHOD"]) == "method"
    assert rows(spark.createDataFrame([("rate is 0.25!",), ("none",)], "t string").select(report.number_in_text(F.col("t")).alias("x")), "x") == [(0.25,), (None,)]


def test_overlap_coverage_delta(spark):
    a = spark.createDataFrame([("1", f"r{i}", 1.0, i) for i in range(1, 11)] + [("2", "r1", 1.0, 1)], REC)
    b = spark.createDataFrame([("1", f"r{i + 5}", 1.0, i) for i in range(1, 11)], REC)
    o = rank.overlap_at10(a, b).first()
    assert (o.common, o.jobs, o.overlap) == (5, 1, 0.5) and rank.overlap_at10(a, b.limit(0)).first().overlap == 0.0
    c = rank.coverage(a).first()
    assert (c.full, c.jobs, c.fraction) == (1, 2, 0.5)
    d = {r.resume_id: r.delta for r in rank.rank_delta(a, b).where("job_id = '1'").collect()}
    assert d["r6"] == -5 and d["r1"] is None


def test_streams(spark, tmp_path):
    import datetime as dt

    from pairloom.streaming import counts

    rows_ = [(i, 1 if i % 2 else 0, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(40)]
    df = spark.createDataFrame(rows_ + rows_[:5], "label_row long, label int, labeled_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = counts.label_stream(spark, str(tmp_path / "in"), df.schema)
    out = counts.run_once(counts.labels_per_window(s), "windows", str(tmp_path / "cp"))
    assert out.agg(F.sum("n")).first()[0] == 40
    counts.group_counts(counts.label_stream(spark, str(tmp_path / "in"), df.schema), ["label"], str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 45


def test_scans(spark, tmp_path):
    from pairloom.sources import scans

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "train.csv").write_text('Filename,Match %\nx.pdf,"81,5 %"\ny,bad\n')
    (tmp_path / "a" / "other.csv").write_text("id,score\n1,2\n")
    (tmp_path / "a" / "none.csv").write_text("p,q\n1,2\n")
    best = scans.find_mapping(spark, str(tmp_path))
    assert best.endswith("train.csv") and scans.find_mapping(spark, str(tmp_path / "missing")) is None
    (tmp_path / "m.csv").write_text("resume_id,score\nx.pdf,81.5 %\ny,bad\n")
    assert rows(scans.match_pairs(spark, str(tmp_path / "m.csv")), "resume_id", "match_percent") == [("x", 81.5), ("y", 0.0)]
    assert scans.overall_metrics(spark, str(tmp_path)) is None
    (tmp_path / "overall_metrics.csv").write_text("source,p_at_10\ntfidf,0.5\n")
    assert scans.overall_metrics(spark, str(tmp_path)).first().source == "tfidf"
    kv = spark.createDataFrame([("dp_difference", "0.25 pp")], "metric string, overall string")
    one = spark.createDataFrame([("dp ratio: 0.8",)], "t string")
    wide = spark.createDataFrame([("g=F", "n", 0.5)], "g string, c string, r double")
    assert [rows(scans.fairness_values(x), "key", "value") for x in (kv, one, wide)] == [[("dp_difference", 0.25)], [("dp ratio", 0.8)], [("g=F", 0.5)]]
    lab = spark.createDataFrame([("j", "a", 5.0), ("j", "b", None), ("j", "a", 7.0)], "job_id string, resume_id string, match_percent double")
    assert rows(scans.top_labels(lab, 1), "resume_id", "match_percent", "y") == [("a", 7.0, 1), ("b", 0.0, 0)]
