"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Method: texts are cut into pre-tokens with positions; each distinct pre-token is encoded once; the ids are joined back and
reassembled by position. Decoding joins the table of token bytes. The pre-token pattern is applied by the JVM; texts
with characters that the JVM's Unicode tables do not know are cut by Python instead, with the same pattern.

Texts are cut once and the pre-tokens stored by columns. The dictionary is joined by broadcast as far as its size allows:
all of it where it is measured small, else its most frequent pre-tokens, a fixed number. Only the others, none of which is
frequent, are shuffled with their positions, and only texts that hold such meet them again.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import session
from pairloom.session import cut, stored

#: Where the public tokenizer files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("PAIRLOOM_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"

# The tokenizer's pre-token pattern, as published and with Unicode's white space written out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WRITTEN_OUT = PATTERN.replace(r"[^\s", f"[^{_WS}").replace(r"(?!\S)", f"(?![^{_WS}])").replace(r"\s+", f"[{_WS}]+")
@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = NAME):
    """The tokenizer, built once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cut(texts: pd.Series) -> pd.Series:
    import regex

    find = regex.compile(WRITTEN_OUT).findall
    return pd.Series([[] if t is None else find(t) for t in texts], dtype=object)


def pretokens(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, a row number within this plan (_rid) and the pre-tokens of each text as an array; null text gives an empty one."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.monotonically_increasing_id().alias("_rid")).withColumn("_new", F.col("_t").rlike(r"\p{Cn}"))
    other = F.pandas_udf(_cut, "array<string>")(F.when(F.col("_new"), F.col("_t")))  # null, hence nothing to do, for all other rows
    return rows.select(*keep, "_rid", F.when(F.col("_new"), other).otherwise(F.regexp_extract_all("_t", F.lit(WRITTEN_OUT), F.lit(0))).alias("_p"))


def word_ids(words: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The words with `wids`, for distinct words (word, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for pdf in batches:
            yield pdf.assign(wids=[enc.encode_ordinary(w) for w in pdf["word"]])

    return words.mapInPandas(run, "word string, n long, wids array<int>")


def _lists(offsets: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def looked_up(batch: pa.RecordBatch, words: pa.Array, first: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    """A batch (_rid, _id, _p) with the ids of the known pre-tokens of each text, and the unknown ones (`tail`) with the places in the ids where theirs belong (`cuts`).

    words are the known pre-tokens; the ids of words[i] are flat[first[i]:first[i + 1]].
    """
    lists = batch.column("_p")
    pre = lists.flatten()
    text_at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))])
    hit = pc.index_in(pre, value_set=words)
    known = np.asarray(pc.is_valid(hit))
    at = np.asarray(pc.fill_null(hit, 0), dtype=np.int64)
    n = np.where(known, first[at + 1] - first[at], 0) if len(words) else np.zeros(len(pre), np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])] if len(words) else np.zeros(0, np.int32)
    missing = np.flatnonzero(~known)
    begins = ends[text_at]
    own = np.searchsorted(text_at, missing, side="right") - 1
    per_text = np.searchsorted(missing, text_at)
    return pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("_id"), _lists(begins, ids), _lists(per_text, (ends[missing] - begins[own]).astype(np.int32)), _lists(per_text, pre.take(pa.array(missing)))], ["_rid", "_id", "ids", "cuts", "tail"])


def encode(df: DataFrame, id_col: str, text: str, folder: str = TOKENIZERS, name: str = NAME, frequent: int = session.FREQUENT) -> DataFrame:
    """(id_col, ids): the token ids of every row, in order, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are ordinary text. Each input row gives one row, also
    where ids repeat or are null. Extra columns are ignored.
    """
    spark = df.sparkSession
    pre = stored(pretokens(df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", ["_id"]))
    dictionary = cut(word_ids(pre.select(F.explode("_p").alias("word")).groupBy("word").agg(F.count("*").alias("n")), folder, name))
    all_small = session.is_small(dictionary)
    head = dictionary if all_small else cut(dictionary.where(F.octet_length("word") <= session.FREQUENT_BYTES).orderBy(F.col("n").desc(), "word").limit(frequent))
    rows = head.select("word", "wids").toPandas()  # bounded by is_small or by `frequent` pre-tokens of FREQUENT_BYTES
    first = np.concatenate([[0], np.cumsum([len(x) for x in rows["wids"]])]).astype(np.int64)
    known = spark.sparkContext.broadcast((pa.array(list(rows["word"]), pa.string()), first, np.array([i for x in rows["wids"] for i in x], dtype=np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield looked_up(batch, *known.value)

    joined = pre.mapInArrow(run, f"_rid long, _id {dict(df.dtypes)[id_col]}, ids array<int>, cuts array<int>, tail array<string>")
    if all_small:
        return joined.select(F.col("_id").alias(id_col), "ids")
    joined = stored(joined)
    rare = dictionary.join(F.broadcast(head.select("word")), "word", "left_anti").select("word", "wids")
    found = joined.select("_rid", F.posexplode("tail").alias("k", "word")).join(rare, "word").groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("k", "wids"))).alias("w"))
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("cuts", k - 1))
    until = lambda k: F.coalesce(F.get("cuts", k), F.size("ids"))
    piece = lambda k: F.concat(F.slice("ids", start(k) + 1, until(k) - start(k)), F.coalesce(F.get("w", k)["wids"], F.array().cast("array<int>")))
    filled = joined.where(F.size("tail") > 0).join(found, "_rid").select(F.col("_id").alias(id_col), F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), piece)).alias("ids"))
    return filled.unionByName(joined.where(F.size("tail") == 0).select(F.col("_id").alias(id_col), "ids"))


def token_bytes(spark: SparkSession, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(token, hex): the bytes of each token of the vocabulary, a table of fixed size (50,256 rows)."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        rows = [(int(b), base64.b64decode(a).hex()) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["token", "hex"]).astype({"token": "int32"}))


def decode(df: DataFrame, id_col: str, ids: str, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id_col, text) from lists of ids; an empty or null list gives the empty text, ids outside the vocabulary are left out."""
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"), F.monotonically_increasing_id().alias("_rid"))
    # the vocabulary has a fixed size of 50,256 short rows, so it may always be broadcast
    parts = rows.select("_rid", "_id", F.posexplode_outer("_ids").alias("pos", "token")).join(F.broadcast(token_bytes(df.sparkSession, folder, name)), "token", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda x: x["hex"]), "")
    return parts.groupBy("_rid", "_id").agg(F.decode(F.unhex(text), "UTF-8").alias("text")).select(F.col("_id").alias(id_col), "text")


def token_counts(texts: pd.Series) -> pd.Series:
    enc = encoding()
    return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")
