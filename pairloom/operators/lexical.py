"""Lexical scoring of text pairs: TF-IDF cosine and BM25, in both directions.

All rows of one table are scored against all rows of the other. Texts are cut once into blocks of sparse rows, and every
block of queries meets every block of documents without a shuffle of either: products of the block's most frequent tokens
are a matrix product, those of the others are added one by one. That is in single precision and only tells which pairs can
be among a query's best, with a bound of its error; those are scored again in double precision. So no pair with a common
token is left out, and a block gives the k best of each query. Lists shorter than k are filled up with zero scores.
`tfidf_scores` and `bm25_scores` give all pairs with a common token by joins of tokens, for small sets of queries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.rank import DIGITS, fill_zeros, topk
from pairloom.session import cut, frequent_join, small_side

WORDS1 = r"[\p{L}\p{N}_]+"
WORDS2 = r"[\p{L}\p{N}_]{2,}"
K1, B = 1.5, 0.75
#: Documents and bytes of text that a block should hold, and the blocks of a table that has at least so many times LEAST_BLOCK documents.
BLOCK, BLOCK_BYTES, BLOCKS, LEAST_BLOCK = 65_536, 48 << 20, 6, 256
#: Tokens of a pair of blocks that are multiplied as a matrix, documents and queries of a step, and single products and cells of a step.
DENSE, DOCS, QUERIES, PRODUCTS = 512, 8_192, 1_024, 2_000_000


def corpus(df: DataFrame, key: str, text: str, order: str = "row_num", parts: int | None = None) -> DataFrame:
    """(id, text): one row per trimmed non-blank id, the first in order; null text is empty. In so many partitions, if given."""
    rows = df.select(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(order).alias("_o")).where("id IS NOT NULL")
    return (rows.repartition(parts, "id") if parts else rows).groupBy("id").agg(F.min_by("text", "_o").alias("text"))


def block_count(df: DataFrame, text: str) -> int:
    """The blocks that a table's texts take."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(-(-n // BLOCK), -(-size // BLOCK_BYTES), min(BLOCKS, n // LEAST_BLOCK), 1)


def term_counts(docs: DataFrame, pattern: str = WORDS2) -> DataFrame:
    """(id, token, f) of lower-cased tokens; documents without tokens have no rows."""
    return docs.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("f"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def smoothed_idf(df: DataFrame, n: int) -> DataFrame:
    """idf = ln((1 + n) / (1 + df)) + 1."""
    return df.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def tfidf_scores(queries: DataFrame, docs: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """(query, doc, score): cosine of TF-IDF vectors of all pairs with a common token; the vocabulary is that of fitted_on (id, text, kind)."""
    n = fitted_on.count()
    every = fitted_on.select(F.concat("kind", F.lit("|"), "id").alias("id"), "text")
    idf = cut(smoothed_idf(document_frequencies(term_counts(every)), n))

    def weights(side: DataFrame) -> DataFrame:
        return frequent_join(term_counts(side), idf, "token", "df").select("id", "token", (F.col("f") * F.col("idf")).alias("w"))

    def norms(w: DataFrame, name: str) -> DataFrame:
        return w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))

    wq, wd = cut(weights(queries)), cut(weights(docs))  # both are used twice
    dots = wd.join(small_side(wq.withColumnsRenamed({"id": "query", "w": "wq"})), "token").groupBy("query", "id").agg(F.sum(F.col("w") * F.col("wq")).alias("dot"))
    j = dots.join(small_side(norms(wq, "nq").withColumnRenamed("id", "query")), "query").join(norms(wd, "nd"), "id")
    return j.select("query", F.col("id").alias("doc"), (F.col("dot") / (F.col("nq") * F.col("nd"))).alias("score"))


def bm25_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, doc, score): BM25 with statistics of the document side; a token repeated in the query counts each time."""
    tf = cut(term_counts(docs, WORDS1))  # used for statistics, lengths and scores
    n = docs.count()
    total = tf.agg(F.sum("f")).first()[0] or 0
    avgdl = (total / n) if n and total else 1.0
    idf = document_frequencies(tf).select("token", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    q = small_side(term_counts(queries, WORDS1).withColumnsRenamed({"id": "query", "f": "qf"}).join(idf, "token"))
    dl = tf.groupBy("id").agg(F.sum("f").alias("dl"))
    part = F.col("qf") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return tf.join(dl, "id").join(q, "token").groupBy("query", "id").agg(F.sum(part).alias("score")).withColumnRenamed("id", "doc")


def blocks(docs: DataFrame, pattern: str = WORDS2) -> DataFrame:
    """(b, ids, vocab, df, tokens, data): each partition of docs as one row of sorted ids, distinct tokens, documents per token, number of tokens and packed sparse rows of token counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("b", pa.int32()), ("id", pa.string()), ("t", pa.list_(pa.string()))])) if (batches := [pa.RecordBatch.from_arrays(x.columns, names=["b", "id", "t"]) for x in batches if x.num_rows]) else None
        if t is None:
            return
        t = t.sort_by("id")  # by code points
        lists = [c for c in t["t"].chunks if len(c)]
        words = pa.chunked_array([c.flatten() for c in lists], pa.string()).combine_chunks().dictionary_encode()
        lengths = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in lists])
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        vocab, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        v = max(len(vocab), 1)
        cells, f = np.unique(np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * v + code, return_counts=True)
        starts = np.searchsorted(cells, np.arange(len(lengths) + 1, dtype=np.int64) * v)
        tok = (cells % v).astype(np.int32)
        packed = [zlib.compress(x.tobytes(), 1) for x in (starts.astype(np.int64), tok, f.astype(np.int32))]
        row = {"b": [t["b"][0].as_py()], "ids": [t["id"].to_pylist()], "vocab": [vocab.to_pylist()], "df": [np.bincount(tok, minlength=len(vocab)).tolist()], "tokens": [int(lengths.sum())], "data": [packed]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("b", pa.int32()), ("ids", pa.list_(pa.string())), ("vocab", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("tokens", pa.int64()), ("data", pa.list_(pa.binary()))]))

    rows = docs.select(F.spark_partition_id().alias("b"), "id", F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)).alias("t"))
    return cut(rows.mapInArrow(build, "b int, ids array<string>, vocab array<string>, df array<int>, tokens bigint, data array<binary>"))


def block_ids(blocked: DataFrame) -> DataFrame:
    return blocked.select(F.explode("ids").alias("id"))


def with_idf(blocked: DataFrame, fitted_on: list[DataFrame], idf: Column) -> DataFrame:
    """Blocks with the idf of each token of their vocabulary, by its documents `df` in all blocks of fitted_on."""
    every = None
    for x in fitted_on:
        part = x.select(F.explode(F.arrays_zip("vocab", "df")).alias("x")).select(F.col("x.vocab").alias("token"), F.col("x.df").alias("df"))
        every = part if every is None else every.unionByName(part)
    table = every.groupBy("token").agg(F.sum("df").alias("df")).select("token", idf.alias("idf"))
    own = blocked.select("b", F.posexplode("vocab").alias("pos", "token")).join(table, "token").groupBy("b").agg(F.array_sort(F.collect_list(F.struct("pos", "idf"))).alias("x")).select("b", F.col("x.idf").alias("idf"))
    return blocked.join(small_side(cut(own)), "b", "left").select("ids", "vocab", "data", "idf")


def tfidf_best(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, score): the k documents of highest TF-IDF cosine per query; the vocabulary is that of both sides. Scores of zero are left out."""
    n = sum(x.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0] for x in (queries, docs))
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    return _best(with_idf(queries, [queries, docs], idf), with_idf(docs, [queries, docs], idf), _cosine, _cosine, k)


def bm25_best(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, score): the k documents of highest BM25 per query, with the statistics of docs. Scores of zero are left out."""
    n, total = docs.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    avgdl = total / n if n and total else 1.0

    def part(starts: np.ndarray, tok: np.ndarray, f: np.ndarray, idf: np.ndarray) -> np.ndarray:
        dl = np.repeat(_row_sums(f, starts), np.diff(starts))
        return idf[tok] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))

    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return _best(queries.select("ids", "vocab", "data", F.lit(None).cast("array<double>").alias("idf")), with_idf(docs, [docs], idf), lambda starts, tok, f, idf: f, part, k)


def _row_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0.0], np.cumsum(x)))[starts]) if x.dtype.kind != "f" or (x == np.floor(x)).all() else np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), weights=x, minlength=len(starts) - 1)


def _cosine(starts: np.ndarray, tok: np.ndarray, f: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = f * idf[tok]
    return w / np.repeat(np.sqrt(_row_sums(w * w, starts)), np.diff(starts))


def _best(queries: DataFrame, docs: DataFrame, weigh_q, weigh_d, k: int) -> DataFrame:
    """(query, doc, score) of the k best per query, each pair of blocks a task that reads the stored blocks; only the k best of each pair of blocks are shuffled."""

    def side(batch: pa.RecordBatch, i: int, at: int, weigh) -> tuple:
        ids, vocab, data, idf = (batch.column(at + j).slice(i, 1).flatten() for j in range(4))
        starts, tok, f = (np.frombuffer(zlib.decompress(x.as_py()), d) for x, d in zip(data, (np.int64, np.int32, np.int32)))
        return ids, vocab, starts, tok, weigh(starts, tok, f.astype(np.float64), idf.to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qv, *q = side(batch, i, 0, weigh_q)
                di, dv, *d = side(batch, i, 4, weigh_d)
                at = pc.index_in(qv, value_set=dv).fill_null(-1).to_numpy(zero_copy_only=False)
                a, b, s = best_of_block(_shared(q, at), _shared(d, _seen(at, len(dv))), len(dv), k)
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(a)), di.take(pa.array(b)), pa.array(s)], names=["query", "doc", "score"])

    renamed = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("ids", "vocab", "data", "idf")])
    pairs = renamed(queries, "q").crossJoin(renamed(docs, "d").hint("shuffle_replicate_nl")).mapInArrow(run, "query string, doc string, score double")
    return topk(pairs, "query", "doc", k=k).select("query", "doc", "score")


def _seen(at: np.ndarray, n: int) -> np.ndarray:
    """The identity for tokens that stand in `at`, -1 for others."""
    out = np.full(n, -1, np.int64)
    out[at[at >= 0]] = at[at >= 0]
    return out


def _shared(rows: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (starts, tokens, weights) with tokens renamed; those renamed -1 are dropped."""
    starts, tok, w = rows
    to = at[tok] if len(tok) else np.zeros(0, np.int64)
    keep = to >= 0
    return np.concatenate(([0], np.cumsum(keep)))[starts], to[keep], w[keep]


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin[i] .. begin[i] + length[i] - 1 of all i in a row."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)


def best_of_block(queries: tuple, docs: tuple, v: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, score) by place: the k best documents per query of sparse rows (starts, tokens, weights) over v tokens, all weights positive; by rounded score, then place. Scores that round to zero are left out."""
    (qs, qt, qw), (ds, dt, dw) = queries, docs
    nq, nd = len(qs) - 1, len(ds) - 1
    # the tokens with most products first: the matrix takes these
    order = np.argsort(-(np.bincount(qt, minlength=v).astype(np.float64) * np.bincount(dt, minlength=v)), kind="stable")
    place = np.empty(v, np.int64)
    place[order] = np.arange(v)
    dense = min(DENSE, v)
    qt, dt = place[qt], place[dt]
    # relative error of a sum of so many positive products in single precision, twice over
    slack = 2.0 * (int(np.diff(qs).max(initial=0)) + 8) * 2.0**-24
    half = 0.5 * 10.0**-DIGITS
    top_q, top_d, top_s = [np.zeros(0, np.int64)] * -(-nq // QUERIES), [np.zeros(0, np.int64)] * -(-nq // QUERIES), [np.zeros(0)] * -(-nq // QUERIES)
    least = np.zeros(nq)  # a query's k-th best rounded score so far
    step_q = max(1, min(QUERIES, PRODUCTS // max(v, 1)))  # queries of a step of the exact scores
    look = np.zeros((step_q, v))

    def matrix(s: np.ndarray, t: np.ndarray, w: np.ndarray, lo: int, hi: int):
        """Rows lo to hi: their frequent tokens as a matrix and the row, token and weight of each other one."""
        part, tok, row = slice(s[lo], s[hi]), t[s[lo] : s[hi]], np.repeat(np.arange(hi - lo), np.diff(s[lo : hi + 1]))
        m = np.zeros((hi - lo, dense), np.float32)
        inner = tok < dense
        m[row[inner], tok[inner]] = w[part][inner]
        return m, row[~inner], tok[~inner], w[part][~inner].astype(np.float32)

    for d0 in range(0, nd, DOCS):
        d1 = min(d0 + DOCS, nd)
        dm, drow, dtok, dwt = matrix(ds, dt, dw, d0, d1)
        by = np.argsort(dtok, kind="stable")
        drow, dwt = drow[by], dwt[by]
        listed = np.concatenate(([0], np.cumsum(np.bincount(dtok, minlength=v))))
        for c, q0 in enumerate(range(0, nq, QUERIES)):
            q1 = min(q0 + QUERIES, nq)
            qm, qrow, qtok, qwt = matrix(qs, qt, qw, q0, q1)
            s = qm @ dm.T
            flat, length = s.reshape(-1), listed[qtok + 1] - listed[qtok]
            some = length > 0
            qrow, qtok, qwt, length = qrow[some], qtok[some], qwt[some], length[some]
            done = 0
            ends = np.cumsum(length)
            while done < len(length):
                to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PRODUCTS, "right")))
                at, n = _spans(listed[qtok[done:to]], length[done:to]), length[done:to]
                np.add.at(flat, np.repeat(qrow[done:to] * (d1 - d0), n) + drow[at], np.repeat(qwt[done:to], n) * dwt[at])
                done = to
            # later documents need a better score than the k-th so far, as places decide between equal ones
            low = np.where(least[q0:q1] > 0, least[q0:q1], 0.0) + half
            low = (low * (1 - slack) - 1e-9).astype(np.float32)
            hit = s >= low[:, None]
            if np.count_nonzero(hit) > 4 * k * (q1 - q0) and d1 - d0 > k:
                kth = np.partition(s, d1 - d0 - k, axis=1)[:, d1 - d0 - k].astype(np.float64)
                low = np.maximum(low, ((kth - 2 * half) * (1 - 2 * slack) - 1e-9).astype(np.float32))
                hit = s >= low[:, None]
            hit = np.flatnonzero(hit)
            if not len(hit):
                continue
            a, b = hit // (d1 - d0), d0 + hit % (d1 - d0)
            edges = np.searchsorted(a, np.arange(0, q1 - q0 + step_q, step_q))
            scores = np.empty(len(a))
            for e, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                if x == y:
                    continue
                r0 = e * step_q
                r1 = min(r0 + step_q, q1 - q0)
                part = slice(qs[q0 + r0], qs[q0 + r1])
                cells = np.repeat(np.arange(r1 - r0), np.diff(qs[q0 + r0 : q0 + r1 + 1])), qt[part]
                look[cells] = qw[part]
                for z in range(x, y, max(1, PRODUCTS // 100)):
                    o = slice(z, min(y, z + max(1, PRODUCTS // 100)))
                    n = ds[b[o] + 1] - ds[b[o]]
                    at = _spans(ds[b[o]], n)
                    scores[o] = np.bincount(np.repeat(np.arange(len(n)), n), weights=look[np.repeat(a[o] - r0, n), dt[at]] * dw[at], minlength=len(n))
                look[cells] = 0.0
            scores = np.round(scores, DIGITS) + 0.0
            a, b, scores = (np.concatenate((o, x[scores > 0])) for o, x in ((top_q[c], a + q0), (top_d[c], b), (top_s[c], scores)))
            by = np.lexsort((b, -scores, a))
            a, b, scores = a[by], b[by], scores[by]
            nth = np.arange(len(a)) - np.searchsorted(a, a)
            last = nth == k - 1
            least[a[last]] = scores[last]
            top_q[c], top_d[c], top_s[c] = a[nth < k], b[nth < k], scores[nth < k]
    join = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
    return join(top_q, np.int64), join(top_d, np.int64), join(top_s, np.float64)


def ranking(scores: DataFrame, queries: DataFrame, docs: DataFrame, left: str, right: str, source: str, k: int = 10) -> DataFrame:
    """(left, right, score, rank, source) of the k best documents per query, zero scores included."""
    named = scores.withColumnsRenamed({"query": left, "doc": right})
    return topk(fill_zeros(named, queries.withColumnRenamed("id", left), docs.withColumnRenamed("id", right), left, right, k), left, right, k=k).select(left, right, "score", "rank", F.lit(source).alias("source"))


def bm25_stats(docs: DataFrame) -> DataFrame:
    """Documents, tokens, average length and vocabulary size; one row."""
    tf = term_counts(docs, WORDS1)
    words = tf.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("tokens"), F.countDistinct("token").alias("vocabulary")).withColumn("k", F.lit(1))
    return docs.agg(F.count("*").alias("docs")).withColumn("k", F.lit(1)).join(words, "k").select("docs", "tokens", "vocabulary", F.round(F.when(F.col("docs") > 0, F.col("tokens") / F.col("docs")).otherwise(1.0), 6).alias("avgdl"))
