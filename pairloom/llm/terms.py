"""How distinctive a term is per record (problem 6), by graphs of words.

Method: the tokens of each record form a graph: every token is joined to those that follow it within a window, the last
to an end mark. A term's weight is its number of distinct neighbours, times the rarity ln(n / d) over all records of the
collection. The same edges give the number of occurrences: each occurrence has exactly one edge to the position after it
(the end mark included), so a term's multiplicity over edges of distance 1 is its frequency. The weight is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.session import cut, frequent_join

TERM = r"[\p{L}\p{N}_]{2,}"
WINDOW = 3


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def word_graph(tokens: list[str], window: int = WINDOW) -> tuple[list[str], list[int], list[int]]:
    """Terms of one record with their multiplicity over edges to the next position, and their numbers of distinct neighbours."""
    near: dict[str, set] = {}
    following: dict[str, int] = {}
    n = len(tokens)
    for i, x in enumerate(tokens):
        following[x] = following.get(x, 0) + 1  # the edge to the next position, or to the end mark
        own = near.setdefault(x, set())
        for y in tokens[i + 1 : min(i + window, n)]:
            own.add(y)
            near.setdefault(y, set()).add(x)
    return list(following), list(following.values()), [len(near[t]) - (t in near[t]) for t in following]


def record_terms(records: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_rid, table_name, row_num, term, f, degree) of each record's graph. Graphs are built record by record in Arrow batches, so neither texts nor edges are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [word_graph(list(t), window) for t in pdf["_t"]]
            yield pd.DataFrame({"_rid": pdf["_rid"], "table_name": pdf["table_name"], "row_num": pdf["row_num"], "term": [m[0] for m in made], "f": [m[1] for m in made], "degree": [m[2] for m in made]})

    tokens = records.select("_rid", "table_name", "row_num", terms_of(F.col("text")).alias("_t")).where(F.size("_t") > 0)
    kinds = dict(records.dtypes)
    packed = tokens.mapInPandas(run, f"_rid long, table_name {kinds['table_name']}, row_num {kinds['row_num']}, term array<string>, f array<long>, degree array<long>")
    return packed.select("_rid", "table_name", "row_num", F.inline(F.arrays_zip("term", "f", "degree")))


def scored(records: DataFrame, window: int = WINDOW, min_records: int = 1) -> DataFrame:
    """(_rid, table_name, row_num, term, f, degree, d, gow, tf): both scores of every term with d >= min_records.

    records: table_name, row_num, text. Null, empty and term-less texts give no rows and do not count in n. Repeated rows
    count as records of their own. gow = degree * ln(n / d), tf = f * ln(n / d), rounded to 6 digits.
    """
    records = records.select("table_name", "row_num", "text", F.monotonically_increasing_id().alias("_rid"))
    n = records.where(F.lower("text").rlike(TERM)).count()
    per = record_terms(records, window)
    rarity = records.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("d")).where(F.col("d") >= min_records)
    rarity = cut(rarity)
    idf = F.log(F.lit(float(max(n, 1))) / F.col("d"))
    return frequent_join(per, rarity, "term", "d").select("_rid", "table_name", "row_num", "term", "f", "degree", "d", F.round(F.col("degree") * idf, 6).alias("gow"), F.round(F.col("f") * idf, 6).alias("tf"))


def top_terms(records: DataFrame, weight: str = "gow", k: int = 1, window: int = WINDOW, min_records: int = 2) -> DataFrame:
    """(table_name, row_num, term, score, place): the k best terms of each record by the weight `gow` or `tf`, ties by code points."""
    s = scored(records, window, min_records)
    if k == 1:
        best = s.groupBy("_rid", "table_name", "row_num").agg(F.min(F.struct((-F.col(weight)).alias("ns"), "term")).alias("b"))
        return best.select("table_name", "row_num", F.col("b.term").alias("term"), (-F.col("b.ns")).alias("score"), F.lit(1).alias("place"))
    w = W.partitionBy("_rid").orderBy(F.col(weight).desc(), F.col("term"))
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("table_name", "row_num", "term", F.col(weight).alias("score"), "place")
