"""Personal information inside free text (problem 3), by bootstrapped contextual extraction.

Method: spans that could be an item are candidates, each with the words before and after it and its shape. Seed entities
and seed words give the first scores; then, over the bipartite graph of patterns and instances, Spark scores patterns by
the instances they surround and instances by their patterns, round by round, so that reliable patterns discover unseen
identifiers, given names, family names and streets, which in turn make further patterns reliable.

* numbers: shapes (digits as 9) against the words before them, for `phone`, `id_number` or neither;
* names: given and family tokens (seeds: the two parts of e-mail addresses) against the words before and after;
* addresses: spans of a known form (seeds) score the words before them, which then admit spans of unknown form;
* e-mail addresses: by their form, also when written out in words.

A pattern, token or shape counts when its smoothed share of confirmed uses is high enough: the smoothing asks small numbers
for unanimity, and no absolute number of uses decides, so the rules are alike at every size. The model (patterns, tokens,
shapes) is a set of tables that can be fitted on one corpus, written, and applied to other texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut, small_side, table

ROUNDS = 4
KINDS = ("email", "phone", "id_number", "address", "name")

# Seed words before numbers.
PHONE_WORDS = r"(?i)phone|\btel\b|\btel\.|t[ée]l[ée]ph|telefon|\bcell|mobil|\bfax|call me|\btext\b|m[óo]vil|whatsapp|handy"
ID_WORDS = r"(?i)\bssn\b|social|soc\. ?sec|\bsec\.|security|passport|passeport|reisepass|pasaporte|insurance|\bni\b|\bnino\b|\bdni\b|\bnie\b|identity|national id|id card|personalausweis"
OTHER_WORDS = r"(?i)\blot\b|\bpo\b|batch|order|\bref\b|ref\.|release|version|subnet|worked|again|invoice|room|from|between|zum|item|part|serial|ticket|case|page"
DATE_SHAPES = r"^(9999[-–/]9999|99?[./-] ?99?[./-] ?9999|9999[./-]99?[./-]99?|99?\.99?\.99?\.99?|9999)$"

# Words of addresses.
STREET = r"Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Crescent|Boulevard|Blvd|Parkway|Row|Mews|Gardens|Grove|Hill|Highway"
UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|\#)\s?\d{1,4}[A-Za-z]?"
ADDRESS = regex.compile(
    rf"(?<![\w.])(?:(?:(?P<u>{UNIT}),?\s)?\d{{1,5}}[A-Za-z]?\s(?:[NSEW]\.\s)?(?:\p{{L}}[\p{{L}}'’-]*\s){{1,3}}(?i:{STREET})\b(?:\.(?=,?\s?{UNIT}))?(?:,?\s{UNIT})?"
    r"|\d{1,4}\s?(?:bis|ter|quater)?,?\s(?:rue|avenue|boulevard|place|chemin|all[ée]e|impasse|quai|cours|route)\s(?:(?:de la|de l['’]|du|des|de|d['’])\s?)?\p{L}[\p{L}'’-]*(?:\s\p{Lu}[\p{L}'’-]*){0,2}"
    r"|(?:Calle|Avenida|Avda\.|Av\.|Plaza|Paseo|Camino|Via|Viale|Corso|Piazza|Rua|Travessa|Largo)\s(?:(?:de la|de los|de las|del|de|da|do|dos|das)\s)?\p{L}[\p{L}'’-]*(?:\s\p{Lu}[\p{L}'’-]*){0,2},?\s\d{1,5}[A-Za-z]?(?:,\s(?:piso|planta|int\.|scala|andar|apto\.?|puerta|n\.º|nº)\s?\d{1,3}[A-Za-zºª]?(?:\s?[A-Z]\b)?)*"
    r"|\p{Lu}[\p{L}-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer|stieg)\s\d{1,4}\s?[a-z]?(?![\w])"
    r"|ul\.\s\p{Lu}[\p{L}-]*(?:\s\p{Lu}[\p{L}-]*)?\s\d{1,4}[A-Za-z]?(?:\s?[/m.]{1,2}\s?\d{1,4})?)"
)
ANY_ADDRESS = regex.compile(r"(?<=[\p{L}:]\s)(?:(?:\p{Lu}\p{L}+\s\d{1,4},\s)?\d{1,5}[A-Za-z]?\s(?:\p{L}[\p{L}'’.-]*\s?){1,4}?(?:,\s\p{Lu}\p{L}{1,9}\.?\s\d{1,4}[A-Z]?)?|\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?,?\s\d{1,4}[a-zA-Z]?)(?=\s/\s\p{Lu}|,\s\p{Lu}|\sin\s\p{Lu})")

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
AT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|AT|@)\s?[)\]}]\s?|\s(?:AT|at)\s)"
DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?|\s(?:DOT|dot)\s)"
EMAIL = regex.compile(rf"(?<![\w.+%-])(?:mailto:)?(?P<v>[A-Za-z0-9](?:[A-Za-z0-9+%'_-]|\.(?=[A-Za-z0-9_]))*(?:\s?[(\[{{]\s?(?:dot|DOT)\s?[)\]}}]\s?[A-Za-z0-9]+)*{AT}{LABEL}(?:{DOT}{LABEL})+)(?![\w@])")
NUMBER = regex.compile(r"(?<![\w.,/+(-])(?:\+|\()?\d(?:\d|[ .\-/](?=[\d(])|\((?=\d)|\)[ .-]?(?=\d)){5,26}(?<=\d)(?![\w]|[.,/-]\d)")
ALNUM = regex.compile(r"(?<![\w-])(?:[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]|[A-Z]{1,2}[ -]?\d{6,9}|\d{7,9}-?[A-Z])(?![\w-])")
WORD = r"\p{Lu}[\p{L}\p{M}'’]+"
NAME = regex.compile(rf"(?<![\p{{L}}\d@._-])(?P<g>{WORD}(?:-{WORD})?)(?:[ \t](?P<i>\p{{Lu}}\.))?[ \t](?P<f>(?:(?:van|von|de|da|del|di|bin|al|el|la|le|der|den|du|dos|ter)[ \t]){{0,2}}{WORD}(?:-{WORD})?)(?![\p{{L}}@_])")
COMMA_NAME = regex.compile(rf"(?<![\p{{L}}\d@._-])(?P<f>{WORD}(?:-{WORD})?),[ ](?P<g>{WORD}(?:-{WORD})?)(?:[ ](?P<i>\p{{Lu}}\.))?(?![\p{{L}}@_-])")
LOWER_NAME = regex.compile(r"(?<=:[ \t])(?P<g>\p{Ll}[\p{L}'’]+)(?:[ \t](?P<i>\p{L}\.))?[ \t](?P<f>\p{Ll}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)?)(?![\p{L}@_-])")
TOKEN = regex.compile(r"\S+")
#: What a text must hold for the dearer patterns to have a match in it.
AT_SIGN = regex.compile(r"@|[(\[{]\s?(?:at|AT)\s?[)\]}]|\s(?:at|AT)\s[A-Za-z0-9-]+\s?(?:\s(?:dot|DOT)\s|[(\[{]\s?(?:dot|DOT|\.))")
PLACE_END = regex.compile(r"\d[^\d]*?(?:,|\s/|\sin)\s\p{Lu}")
LOWER_START = regex.compile(r":[ \t]\p{Ll}")
#: Shares from which a pattern counts and is strong, from which a token and an address word count, and the smoothing of each.
WEAK, STRONG, TOKEN_SHARE, WORD_SHARE = (0.3, 2.5), (0.6, 2.0), (0.5, 1.2), (0.5, 5.0)
DIGIT = regex.compile(r"\d")
COLUMNS = ["start", "end", "what", "value", "sig", "g", "f", "left1", "left2", "right2"]


def context(text: str, a: int, b: int) -> tuple[str, str, str]:
    """The last word and the last two words before a span, and the two after, lower-case, with digits as 9."""
    left = [DIGIT.sub("9", w).lower() for w in TOKEN.findall(text[max(0, a - 60) : a])[-2:]]
    right = [DIGIT.sub("9", w).lower() for w in TOKEN.findall(text[b : b + 40])[:2]]
    return (left[-1] if left else "^")[-30:], " ".join(left)[-50:] or "^", " ".join(right)[:40]


class Taken:
    """Disjoint spans in order; whether another is free of them is told by its neighbours."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return not i or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def candidates(text: str) -> list[tuple]:
    """(start, end, what, value, shape, given, family, words around) of every span that could be an item."""
    out, taken = [], Taken()
    if AT_SIGN.search(text):
        for m in EMAIL.finditer(text):
            a, b = m.span("v")
            spaced = regex.search(r"\s(?:at|AT)\s", m["v"]) and "@" not in m["v"]
            if spaced and not regex.search(r"\s(?:dot|DOT)\s|[(\[{]\s?(?:dot|DOT)", m["v"]):
                continue
            taken.add(a, b)
            p = regex.match(r"(\p{L}{2,})[._-](\p{L}{2,})(?:\s?@|\s?[(\[{]| AT)", m["v"])
            out.append((a, b, "email", m["v"], "", p[1].lower() if p else None, p[2].lower() if p else None, *context(text, a, b)))
    for m in ADDRESS.finditer(text):
        if taken.free(*m.span()):
            taken.add(*m.span())
            out.append((*m.span(), "address", m[0], "", None, None, *context(text, *m.span())))
    if PLACE_END.search(text):
        for m in ANY_ADDRESS.finditer(text):
            if taken.free(*m.span()):
                out.append((*m.span(), "address?", m[0], "", None, None, *context(text, *m.span())))
    for pattern in (ALNUM, NUMBER):
        for m in pattern.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 6 <= n <= 16 and taken.free(*m.span()):
                taken.add(*m.span())
                out.append((*m.span(), "number", m[0], regex.sub(r"\p{Lu}", "X", DIGIT.sub("9", m[0])), None, None, *context(text, *m.span())))
    for pattern in (NAME, COMMA_NAME, *((LOWER_NAME,) if LOWER_START.search(text) else ())):
        at = 0
        while m := pattern.search(text, at):
            at = m.end("g") if pattern is NAME else m.end()
            if taken.free(*m.span()):
                out.append((*m.span(), "name", m[0], "comma" if pattern is COMMA_NAME else "plain", m["g"].lower(), m["f"].lower(), *context(text, *m.span())))
    return out


def spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per candidate: _key, _rid (the row) and COLUMNS; null and empty texts have none."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, r, *c) for k, r, t in pdf[["k", "_rid", "t"]].itertuples(index=False) for c in candidates(t)], columns=["_key", "_rid", *COLUMNS])

    rid = F.col("_rid") if "_rid" in texts.columns else F.monotonically_increasing_id()
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), rid.alias("_rid")).where(F.length("t") > 0)
    return rows.mapInPandas(run, f"_key {kind}, _rid long, start int, end int, what string, value string, sig string, g string, f string, left1 string, left2 string, right2 string")


def _share(score: Column, n: Column, k: float, prior: float) -> Column:
    return (F.sum(score * n) + F.lit(k * prior)) / (F.sum(n) + F.lit(k))


def number_scores(numbers: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Scores of the words before (kind of pattern, pattern) and of shapes, each for phone and id, by rounds over their graph."""
    seen = numbers.groupBy("sig", "left1", "left2").agg(F.count("*").cast("double").alias("n"))
    edges = cut(seen.select("sig", "n", F.inline(F.array(F.struct(F.lit("left1").alias("side"), F.col("left1").alias("pattern")), F.struct(F.lit("left2").alias("side"), F.col("left2").alias("pattern"))))).groupBy("sig", "side", "pattern").agg(F.sum("n").alias("n")))
    p = F.col("pattern")
    phone, ident, other = p.rlike(PHONE_WORDS), p.rlike(ID_WORDS), p.rlike(OTHER_WORDS)
    known = phone | ident | other
    first = edges.select("side", "pattern").distinct().select("side", "pattern", known.alias("known"), F.when(phone, 1.0).otherwise(0.0).alias("phone"), F.when(ident & ~phone, 1.0).otherwise(0.0).alias("ident"))
    patterns = first.where("known")
    dated = F.col("sig").rlike(DATE_SHAPES)
    for _ in range(rounds):
        # shapes: from the patterns scored so far; dates keep a doubt
        shapes = cut(edges.join(small_side(patterns), ["side", "pattern"]).groupBy("sig").agg(_share(F.col("phone"), F.col("n"), 4.0, 0.2).alias("phone"), _share(F.col("ident"), F.col("n"), 4.0, 0.1).alias("ident")).select("sig", *[(F.col(c) * F.when(dated, 0.2).otherwise(1.0)).alias(c) for c in ("phone", "ident")]))
        learnt = edges.join(small_side(shapes), "sig").groupBy("side", "pattern").agg(_share(F.col("phone"), F.col("n"), 2.0, 0.1).alias("p"), _share(F.col("ident"), F.col("n"), 2.0, 0.1).alias("i"))
        patterns = cut(first.join(learnt, ["side", "pattern"]).select("side", "pattern", "known", F.when(F.col("known"), F.col("phone")).otherwise(F.col("p")).alias("phone"), F.when(F.col("known"), F.col("ident")).otherwise(F.col("i")).alias("ident")))
    return patterns, shapes


FOUND = ["_key", "_rid", "start", "end", "kind", "value"]


def numbers_found(numbers: DataFrame, patterns: DataFrame, shapes: DataFrame) -> DataFrame:
    """The numbers that are phone or identity numbers: seed words decide; elsewhere pattern and shape together. Words and shapes that the model does not know say nothing."""
    side = lambda s, q: small_side(patterns.where(F.col("side") == s).select(F.col("pattern").alias(s), F.col("known").alias(f"known{q}"), F.col("phone").alias(f"phone{q}"), F.col("ident").alias(f"ident{q}")))
    j = numbers.join(side("left1", 1), "left1", "left").join(side("left2", 2), "left2", "left").join(small_side(shapes.withColumnsRenamed({"phone": "phone0", "ident": "ident0"})), "sig", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def score(k: str) -> Column:
        near, far = z(f"{k}1"), z(f"{k}2")
        known1, known2 = F.coalesce("known1", F.lit(False)), F.coalesce("known2", F.lit(False))
        context = F.when(known1, near).when(known2, far).otherwise(F.greatest(near, far))
        return F.when(known1 | known2, context).otherwise(F.sqrt(context * z(f"{k}0")))

    return j.withColumns({"ph": score("phone"), "id": score("ident")}).where("ph > 0.5 OR id > 0.5").withColumn("kind", F.when(F.col("ph") >= F.col("id"), "phone").otherwise("id_number")).select(*FOUND)


def name_model(spans_: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Given tokens, family tokens, patterns (side, pattern, score) and tokens that mostly stand where a family name does, from e-mail seeds by rounds over the graph."""
    seeds = spans_.where("what = 'email' AND g IS NOT NULL").select("g", "f")
    count = seeds.groupBy
    given = cut(count(F.col("g").alias("t")).agg(F.count("*").alias("c")).select("t"))
    family = cut(seeds.groupBy(F.col("f").alias("t")).agg(F.count("*").alias("c")).select("t"))
    parts = spans_.where("what = 'name'").groupBy("g", "f", "left1", "left2", "right2").agg(F.count("*").cast("double").alias("n"))
    edges = cut(parts.withColumn("last", F.element_at(F.split("f", "-"), -1)).withColumn("e", F.xxhash64("g", "f", "left2", "right2", "left1")))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("pattern")) for s in ("left1", "left2", "right2")])
    patterns = follows = None
    for step in range(rounds):
        g, f = small_side(given.withColumnRenamed("t", "g").withColumn("is_g", F.lit(1.0))), small_side(family.withColumnRenamed("t", "last").withColumn("is_f", F.lit(1.0)))
        marked = cut(edges.join(g, "g", "left").join(f, "last", "left").withColumn("yes", F.coalesce("is_g", F.lit(0.0)) * F.coalesce("is_f", F.lit(0.0))).withColumn("half", F.greatest(F.coalesce("is_g", F.lit(0.0)), F.coalesce("is_f", F.lit(0.0)))))
        patterns = cut(marked.select("yes", "half", "n", F.inline(sides)).groupBy("side", "pattern").agg(_share(F.greatest(F.col("yes"), F.col("half") * 0.8), F.col("n"), 1.0, 0.0).alias("score"), F.sum("n").alias("n")).where((F.col("score") * (F.col("n") + 1) / (F.col("n") + WEAK[1]) >= WEAK[0])))
        strong = small_side(patterns.where(F.col("score") * (F.col("n") + 1) / (F.col("n") + STRONG[1]) >= STRONG[0]).select("side", "pattern", "score"))
        per = marked.select("e", F.inline(sides)).join(strong, ["side", "pattern"]).groupBy("e").agg(F.max("score").alias("s"))
        credit = marked.join(per, "e", "left").withColumn("s", F.greatest(F.coalesce("s", F.lit(0.0)), F.col("yes")))
        grown = lambda c: credit.groupBy(F.col(c).alias("t")).agg(F.sum(F.col("s") * F.col("n")).alias("c"), F.sum("n").alias("all")).where(F.col("c") / (F.col("all") + TOKEN_SHARE[1]) >= TOKEN_SHARE[0]).select("t")
        if step == rounds - 1:
            follows = cut(credit.groupBy(F.col("last").alias("t")).agg((F.sum(F.greatest(F.col("s"), F.coalesce("is_g", F.lit(0.0)) * 0.6) * F.col("n")) / F.sum("n")).alias("fits")).where("fits >= 0.5"))
        given, family = cut(given.union(grown("g")).distinct()), cut(family.union(grown("last")).distinct())
    return given, family, patterns, follows


def names_found(spans_: DataFrame, given: DataFrame, family: DataFrame, patterns: DataFrame, follows: DataFrame) -> DataFrame:
    names = spans_.where("what = 'name'").withColumn("last", F.element_at(F.split("f", "-"), -1))
    best = {s: small_side(patterns.where(F.col("side") == s).select(F.col("pattern").alias(s), F.col("score").alias("s_" + s))) for s in ("left1", "left2", "right2")}
    j = names.join(small_side(given.withColumnRenamed("t", "g").withColumn("is_g", F.lit(True))), "g", "left").join(small_side(family.withColumnRenamed("t", "last").withColumn("is_f", F.lit(True))), "last", "left")
    j = j.join(small_side(follows.withColumnRenamed("t", "last")), "last", "left")
    for s, df in best.items():
        j = j.join(df, s, "left")
    top = F.greatest(*[F.coalesce(f"s_{s}", F.lit(0.0)) for s in best])
    both = F.col("is_g") & F.col("is_f")
    z = lambda s: F.coalesce(f"s_{s}", F.lit(0.0))
    framed = 1.0 - (1.0 - F.greatest(z("left1"), z("left2"))) * (1.0 - z("right2"))  # the words on both sides together
    sure = F.when(both, 2.0 + top).when((F.col("is_g") | F.col("is_f")) & (top >= 0.5), 1.0 + top).when(F.col("is_g") & F.col("fits").isNotNull(), 1.0).when((z("left2") > 0) & (framed >= 0.8), framed)
    return j.withColumn("w", sure).where("w IS NOT NULL").select("_key", "_rid", "start", "end", F.lit("name").alias("kind"), "value", "w")


def address_words(spans_: DataFrame) -> DataFrame:
    """(left2): words before addresses of a known form that mostly precede such."""
    total = spans_.where("what IN ('address', 'address?')").groupBy("left2").agg(F.sum(F.when(F.col("what") == "address", 1.0).otherwise(0.0)).alias("yes"), F.count("*").alias("n"))
    return total.where(F.col("yes") / (F.col("n") + WORD_SHARE[1]) >= WORD_SHARE[0]).select("left2")


def addresses_found(spans_: DataFrame, good: DataFrame) -> DataFrame:
    """Addresses of a known form, and spans of any form after the words `good`."""
    named = spans_.withColumn("kind", F.lit("address"))
    return named.where("what = 'address'").select(*FOUND).unionByName(named.where("what = 'address?'").join(small_side(good), "left2", "left_semi").select(*FOUND))


def without_overlap(rows: DataFrame) -> DataFrame:
    """Of overlapping names the surest, then the first; groups are single texts."""
    one = F.struct(F.col("start").alias("a"), F.col("end").alias("b"), F.col("value").alias("v"), F.col("w"))
    packed = rows.groupBy("_rid").agg(F.first("_key").alias("_key"), F.collect_list(one).alias("xs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, rid, xs in zip(pdf["_key"], pdf["_rid"], pdf["xs"]):
                kept = Taken()
                for x in sorted(xs, key=lambda x: (-round(x["w"], 3), x["a"])):
                    if kept.free(x["a"], x["b"]):
                        kept.add(x["a"], x["b"])
                        out.append((key, rid, x["a"], x["b"], "name", x["v"]))
            yield pd.DataFrame(out, columns=FOUND)

    return packed.mapInPandas(run, f"_key {dict(rows.dtypes)['_key']}, _rid long, start int, end int, kind string, value string")


class Model(NamedTuple):
    """What is learnt: words before numbers and shapes of numbers with scores, given and family tokens, patterns of names, tokens that stand as family names, words before addresses."""

    number_words: DataFrame
    shapes: DataFrame
    given: DataFrame
    family: DataFrame
    patterns: DataFrame
    follows: DataFrame
    places: DataFrame

    def save(self, path: str) -> None:
        for name, df in self._asdict().items():
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}.parquet")

    @classmethod
    def load(cls, spark, path: str) -> Model:
        return cls(*(table(spark, path, name) for name in cls._fields))


def fit_spans(s: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all candidates of a corpus (see spans)."""
    return Model(*number_scores(s.where("what = 'number'")), *name_model(s, rounds), cut(address_words(s)))


def fit(texts: DataFrame, text: str, rounds: int = ROUNDS) -> Model:
    """Learns from all texts of a corpus, whole."""
    return fit_spans(cut(spans(texts.select(F.lit(0).alias("k"), F.col(text).alias("t")), "k", "t")), rounds)


def items(texts: DataFrame, key: str, text: str, rounds: int = ROUNDS, model: Model | None = None) -> DataFrame:
    """(key, _rid, start, end, kind, value): every item with its place in the text, in code points from 0.

    Null, empty and item-free texts give no rows. Repeated rows are found alike. Without a model all texts take part in the
    scoring; with one, texts are judged by what it knows, so that a few texts can be served too.
    """
    s = cut(spans(texts, key, text))
    m = model or fit_spans(s, rounds)
    found = s.where("what = 'email'").withColumn("kind", F.lit("email")).select(*FOUND).unionByName(addresses_found(s, m.places)).unionByName(numbers_found(s.where("what = 'number'"), m.number_words, m.shapes))
    found = found.unionByName(without_overlap(names_found(s, m.given, m.family, m.patterns, m.follows)))
    return found.withColumnRenamed("_key", key)


def redacted(texts: DataFrame, key: str, text: str, rounds: int = ROUNDS, model: Model | None = None) -> DataFrame:
    """(key, text, redacted): every text with typed placeholders such as [EMAIL] for its items, all else unchanged; null stays null."""
    numbered = cut(texts.select(F.col(key), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_rid")))
    per = items(numbered, key, "_text", rounds, model).groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("xs"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.when(x["start"] >= acc["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))
    done = F.aggregate(F.coalesce("xs", F.array().cast("array<struct<start:int,end:int,kind:string>>")), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    return numbered.join(per, "_rid", "left").select(F.col(key), F.when(F.col("_text").isNotNull(), done).alias("redacted"))
