"""Garbled text from wrong character encodings (problem 2).

Method: for every sentence the decodings that some chain of wrong and right encodings would give are described by
zstandard with one dictionary per language; the chain with the shortest description, its own cost included, wins, and the
text stays as it is where no chain is shorter. Chains may follow one another (text garbled twice), concern single words
or whole sentences, and may have lost characters, in which case what is left is marked but cannot be restored in full.

The dictionaries are trained here on a bounded sample of labelled text (language, text).
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents from which the dictionaries are trained, at most (about), and the size of each dictionary.
FIT_DOCUMENTS = 6_000
DICT_BYTES = 48 << 10
#: Characters of a document that go into training, at most.
FIT_CHARS = 4_000
DEPTH = 3

# Encodings that UTF-8 is read as, and pairs (read as, written as) of single-byte encodings.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman", "gbk", "cp1251", "cp866", "koi8-r", "iso8859-15", "iso8859-2", "cp1254", "cp1253")
SINGLE_BYTE = (("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1252", "cp1253"), ("cp437", "cp1251"), ("cp437", "koi8-r"), ("mac_roman", "cp1251"), ("cp1252", "cp1250"))
#: Costs in bytes of saying which chain was used.
COST = {"utf8": 0.5, "single": 6.0, "lost": 3.0}
#: More for a pair whose both sides are Latin letters: a right word then has another plausible reading too, so several words must agree.
LATIN_PAIR, LATIN_WORDS = 3.0, 2
UNDEFINED_1252 = "\x81\x8d\x8f\x90\x9d"
#: Characters whose UTF-8 form has two control bytes after 0xE2 when read as Latin-1.
LOST_QUOTES = "’“”–—‘"

WORD = re.compile(r"[^ \n\t\r]+")
UNIT = re.compile(r"[^\n]+?(?:[.!?…](?=\s)|(?=\n)|$)", re.S)
HIGH = re.compile(r"[^\x00-\x7f]")
ENTITY = re.compile(r"&[A-Za-z][A-Za-z0-9]*;|&#\d+;|&#[xX][0-9a-fA-F]+;")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
PUNCT = set(" ¡¢£¤¥¦§¨©ª«¬­®¯°±²³´µ¶·¸¹º»¼½¾¿×÷‘’‚‛“”„‟†‡•…‰‹›–—―‐‑‒€№™−≤≥≠≈→←↑↓∞′″⁄⇒■□▪●○◦★☆✓✔✗ﬁﬂ​‍﻿")


COMBINING = "\u0300\u0301\u0302\u0303\u0308\u030a\u030b\u030c\u0327\u0328"


def to_bytes(word: str, codec: str) -> bytes:
    if codec != "cp1252":
        return word.encode(codec)
    out = bytearray()
    for c in word:
        out += bytes([ord(c)]) if c in UNDEFINED_1252 else c.encode("cp1252")
    return bytes(out)


def script(c: str) -> str:
    o = ord(c)
    if o < 0x80 or 0xC0 <= o <= 0x17F or 0x218 <= o <= 0x21B or c in "ªº":
        return "L"
    if 0x410 <= o <= 0x44F or c in "ЁёІіЇїЄєҐґЎўЂЃЉЊЌЏђѓљњќџЈјЅѕ":
        return "C"
    if 0x370 <= o <= 0x3FF:
        return "G"
    if 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF or c in COMBINING or 0xFE00 <= o <= 0xFE0F:
        return "E"
    return "J" if 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF else "K" if 0xAC00 <= o <= 0xD7A3 else "T" if 0xE00 <= o <= 0xE7F else "H" if 0x900 <= o <= 0x97F else "A" if 0x600 <= o <= 0x6FF else "?"


def plausible(word: str) -> bool:
    """Whether the letters are of one script and the rest are common marks."""
    kinds = set()
    for c in word:
        if c.isalpha():
            kinds.add(script(c))
        elif ord(c) >= 0x80 and c not in PUNCT and script(c) not in "EHTA":
            return False
        elif ord(c) < 0x20:
            return False
    kinds.discard("E")
    return "?" not in kinds and (len(kinds) <= 1 or kinds <= {"J", "K"})


def russian(word: str) -> bool:
    return all(0x410 <= ord(c) <= 0x44F or c in "Ёё" or (ord(c) < 0x80 and not c.isalpha()) or c in "«»“”„–—…№" for c in word)


def lost(word: str) -> list[str]:
    """Readings of UTF-8 read as Latin-1 whose control characters were dropped: whole sequences are decoded, a lone lead byte becomes each character it may have begun."""
    out, i, gaps, sure = [], 0, 0, 0
    try:
        raw = word.encode("latin-1")
    except UnicodeEncodeError:
        return []
    while i < len(raw):
        b = raw[i]
        for n, lead in ((2, 0xC2 <= b <= 0xDF), (3, 0xE0 <= b <= 0xEF)):
            if lead and i + n <= len(raw):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i, sure = i + n, sure + 1
                    break
                except UnicodeDecodeError:
                    pass
        else:
            if b == 0xE2 and raw[i + 1 : i + 2] == b"\xa6":
                out.append("…")
                i, sure = i + 2, sure + 1
            elif b == 0xE2 and raw[i + 1 : i + 2] == b"\xac":
                out.append("€")
                i, sure = i + 2, sure + 1
            elif b in (0xE2, 0xC3):
                out.append(None if b == 0xE2 else 0)
                i, gaps = i + 1, gaps + 1
            elif b >= 0x80:
                return []
            else:
                out.append(chr(b))
                i += 1
    if not gaps:
        return ["".join(out)] if sure else []
    if gaps == 1 and 0 in out:
        return ["".join(c if c != 0 else x for c in out) for x in "ÀÁÂÄÅÇÈÉÊËÌÍÑÒÓÔÖØÙÚÜß"]
    if 0 in out:
        return []
    return ["".join(x if c is None else c for c in out) for x in LOST_QUOTES]


@lru_cache(maxsize=200_000)
def readings(word: str) -> tuple[tuple[str, str], ...]:
    """(chain, reading) of each chain that gives another plausible reading of a word."""
    found = {}
    if "&" in word:
        plain = html.unescape(word)
        if plain != word and HIGH.search(plain):
            for name, r in read(plain):
                found["entity+" + name] = r
    if not HIGH.search(word):
        return tuple(found.items())
    for codec in UTF8_READ_AS:
        try:
            r = to_bytes(word, codec).decode("utf-8")
        except (UnicodeError, ValueError):
            continue
        wide = sum(script(c) in "JKTHA" for c in r if c.isalpha())
        if r != word and plausible(r) and (wide != 1 or not CYRILLIC.search(word)):
            found["utf8:" + codec] = r
        elif r != word and len(r) < len(word) and codec in ("cp1252", "latin-1", "cp1251") and any(n.startswith("utf8") for n, _ in read(r)):
            found["utf8:" + codec] = r
    if not any(k.startswith("utf8") for k in found):
        for r in lost(word):
            if plausible(r):
                found.setdefault("lost:" + next((c for c in r if c in LOST_QUOTES or ord(c) >= 0xC0), ""), r)
    for codec, right in SINGLE_BYTE:
        try:
            r = to_bytes(word, codec).decode(right)
        except (UnicodeError, ValueError):
            continue
        if r != word and right != "cp1250" and right != "cp1253" and russian(r):
            found[f"single:{codec}:{right}"] = r
        elif r != word and right == "cp1250" and plausible(r) and all(script(c) == "L" for c in r if c.isalpha()):
            found[f"single:{codec}:{right}"] = r
        elif r != word and right == "cp1253" and plausible(r) and all(script(c) == "G" for c in r if c.isalpha()):
            found[f"single:{codec}:{right}"] = r
    return tuple(found.items())


def read(word: str) -> tuple[tuple[str, str], ...]:
    """The readings of a word; those of very long words are not kept."""
    return readings(word) if len(word) <= 500 else readings.__wrapped__(word)


class Describer:
    """Description lengths in bytes by language; languages are grouped by whether they write Cyrillic."""

    def __init__(self, dicts: dict[str, bytes]):
        self.by = defaultdict(list)
        for lang, raw in sorted(dicts.items()):
            d = zstandard.ZstdCompressionDict(raw)
            c = zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(level=6)
            kind = {"ru": "C", "el": "G"}.get(lang, "O" if lang in ("ja", "zh", "ko", "ar", "hi", "th") else "L")
            self.by[kind].append(c)
        self.plain = zstandard.ZstdCompressor(level=6, write_checksum=False, write_content_size=False)

    def length(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        kinds = {script(c) for c in text if ord(c) >= 0x80 and c.isalpha()}
        cs = [c for k in ("C", "G", "L", "O") if k in kinds or k == "L" or (k == "O" and kinds & set("JKTHA")) for c in self.by[k]] or [self.plain]
        return min(len(c.compress(raw)) for c in cs)


def restore(text: str, d: Describer) -> tuple[str, list[str], bool]:
    """The text with the shortest description, the chains used, and whether something is lost for good."""
    used, out, at = [], [], 0
    if "�" in text:
        used.append("replaced")
    for m in UNIT.finditer(text):
        unit = m[0]
        if not HIGH.search(unit) and not ENTITY.search(unit):
            continue
        now = unit
        for _ in range(DEPTH):
            by = defaultdict(dict)
            for w in set(WORD.findall(now)):
                if HIGH.search(w) or "&" in w:
                    for chain, r in read(w):
                        by[chain][w] = r
            best, least = None, None
            for chain, change in by.items():
                kind = chain.split(":")[0].rpartition("+")[2]
                if kind == "single" and sum(c.isalpha() for r in change.values() for c in r) < 3:
                    continue
                latin = chain.endswith("cp1250") and kind == "single"
                if latin and len(change) < LATIN_WORDS:
                    continue
                new = WORD.sub(lambda x, change=change: change.get(x[0], x[0]), now)
                if least is None:
                    before = d.length(now)
                    least = before
                # valid UTF-8 hardly arises by chance, which is worth a byte for each of its first two sequences
                luck = min(2, sum(ord(c) >= 0x80 for r in change.values() for c in r)) if kind == "utf8" else 0
                n = d.length(new) + COST[kind] + LATIN_PAIR * latin - luck
                if n < least:
                    best, least = (chain, new), n
            if best is None:
                break
            used.append(best[0])
            now = best[1]
        if now != unit:
            out.append(text[at : m.start()])
            out.append(now)
            at = m.end()
    out.append(text[at:])
    fixed = "".join(out)
    return fixed, used, "�" in fixed or any("lost" in u for u in used)


def train(samples: dict[str, list[str]], size: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary per language; from little text its end itself is the dictionary."""
    out = {}
    for lang, texts in samples.items():
        parts = [p.encode() for t in texts for p in UNIT.findall(t)]
        raw = b"\n".join(parts)
        try:
            if len(raw) < 20 * size or len(parts) < 100:
                raise ValueError("little text")
            out[lang] = zstandard.train_dictionary(size, parts).as_bytes()
        except (zstandard.ZstdError, ValueError):
            out[lang] = raw[-size:] or b" " * 8
    return out


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", fit_documents: int = FIT_DOCUMENTS) -> dict[str, bytes]:
    """Trains on about fit_documents rows, chosen by a hash of the text, each distinct text once; only these, at most twice as many, come to the driver."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.lower(F.trim(lang)).alias("l"), F.substring(F.col(text), 1, FIT_CHARS).alias("t"))
    n = rows.count()
    share = min(1.0, fit_documents / max(n, 1))
    samples = defaultdict(list)
    for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).distinct().orderBy(F.xxhash64(F.lit(1), "t"), "t", "l").limit(2 * fit_documents).toLocalIterator():
        samples[r.l].append(r.t)
    return train(samples)


def restored(texts: DataFrame, keys: list[str], text: str, dicts: dict[str, bytes]) -> DataFrame:
    """The keys, `restored` text, `chains` used (comma-separated) and `is_lossy` of each affected row.

    Null, empty and unaffected texts give no row. Repeated rows are treated alike. Texts are processed whole, sentence by
    sentence. A text with replacement characters is affected even if nothing can be restored.
    """
    shared = texts.sparkSession.sparkContext.broadcast(dicts)  # bounded: one dictionary of DICT_BYTES per language
    kinds = dict(texts.dtypes)
    cols = [*keys, "restored", "chains", "is_lossy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Describer(shared.value)
        for pdf in batches:
            rows = []
            for *k, t in pdf[[*keys, "_t"]].itertuples(index=False):
                fixed, used, lossy = restore(t, d)
                if used:
                    rows.append((*k, fixed, ",".join(dict.fromkeys(used)), lossy))
            yield pd.DataFrame(rows, columns=cols)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", restored string, chains string, is_lossy boolean"
    rows = texts.select(*keys, F.col(text).alias("_t")).where(F.col("_t").rlike(r"[^\x00-\x7f]|&[A-Za-z#]"))
    return rows.mapInPandas(run, schema)
