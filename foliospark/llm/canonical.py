"""One consistent form for text that looks the same.

A text is exploded to positioned code points; these join a broadcast mapping
of decompositions and look-alikes, combining marks are ordered by class, and
base letters and marks are recomposed and rebuilt into a string:

* forms that stand in for a plain character (full-width and half-width forms,
  mathematical letters, Latin ligatures, typographic hyphens) become it; raised
  and lowered figures, fractions, units and letter-like signs stay;
* spaces other than the ordinary one become it, invisible characters go;
* combining accents are composed with their letter;
* look-alike letters of Cyrillic and Greek become the Latin letters they
  resemble if their word mixes them with Latin letters, or consists of
  look-alikes only and is a code or has two letters or more; a word with any
  letter that is no look-alike is wholly in its own script and stays, and so
  does every word of a text without Latin letters that has such a word.

Texts that hold only characters without a stand-in are already in that form;
a regular expression in the JVM, built from the same mapping, lets only the
others into the explosion, each distinct text once. The mapping is a few
thousand rows, made by rule from the Unicode data, and its size is fixed.

Defined results: NULL stays NULL and is no case, the empty text stays empty;
repeated rows get equal results; very long texts are exploded over rows.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that look like Latin ones (fixed values), in alphabetical order of the script.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο"
GREEK_AS = "ABEZHIKMNOPTYXvo"
HYPHENS = "‐‑"
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
_PLAIN_TAGS = {"<wide>", "<narrow>", "<font>"}
_LIGATURES = range(0xFB00, 0xFB07)


@functools.cache
def stand_ins() -> dict[str, str]:
    """Character to plain text, for every stand-in outside look-alike letters."""
    out = dict.fromkeys(INVISIBLE, "") | dict.fromkeys(HYPHENS, "-")
    for cp in range(0xA0, sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        else:
            d = unicodedata.decomposition(c)
            if d.startswith("<") and (d.split()[0] in _PLAIN_TAGS or cp in _LIGATURES):
                out[c] = unicodedata.normalize("NFKC", c)
    return out


@functools.cache
def look_alikes() -> dict[str, str]:
    return dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS))


@functools.cache
def composites() -> tuple[dict[str, str], dict[str, str]]:
    """Letter to its full canonical decomposition, and (letter, mark) to the composed letter."""
    apart, pairs = {}, {}
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and unicodedata.normalize("NFC", c) == c and " " in d:
            a, b = (chr(int(x, 16)) for x in d.split())
            apart[c], pairs[a + b] = unicodedata.normalize("NFD", c), c
    return apart, pairs


def mark_class(c: str) -> int:
    """The combining class, but marks that make another vowel come before tones of their class, as in composed letters."""
    return 229 if c in "\u0302\u0306" else unicodedata.combining(c)


def fold_text(text: str) -> str:
    """The stand-in step alone on the driver or in a worker, for short keys and tests."""
    table = stand_ins()
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in text))


def _char_class(chars: list[str]) -> str:
    """A regular expression class of the characters, as ranges."""
    cps = sorted(map(ord, chars))
    runs, start = [], cps[0]
    for a, b in zip(cps, [*cps[1:], -1]):
        if b != a + 1:
            runs.append(f"\\x{{{start:X}}}" if start == a else f"\\x{{{start:X}}}-\\x{{{a:X}}}")
            start = b
    return "[" + "".join(runs) + "]"


def mapping(spark: SparkSession) -> DataFrame:
    """ch, look, to: to is an array of (out, ccc) in canonical order; look marks letters mapped only by word."""
    apart, _ = composites()
    rows = []
    for c, plain in {**apart, **stand_ins()}.items():
        rows.append((c, False, [(x, mark_class(x)) for x in unicodedata.normalize("NFD", plain)]))
    rows += [(c, True, [(to, 0)]) for c, to in look_alikes().items()]
    marks = [chr(cp) for cp in range(0x300, 0x370) if unicodedata.combining(chr(cp)) and chr(cp) not in INVISIBLE]
    rows += [(m, False, [(x, mark_class(x)) for x in unicodedata.normalize("NFD", m)]) for m in marks]
    return spark.createDataFrame(rows, "ch string, look boolean, to array<struct<out:string,ccc:int>>")


def suspicious(text: Column) -> Column:
    """True if a text may differ from its canonical form; exact for all that it lets pass as plain."""
    chars = [*stand_ins(), *look_alikes(), *(chr(cp) for cp in range(0x300, 0x370))]
    return text.rlike(_char_class(chars))


def _look_folds(word: Column, own_text: Column) -> Column:
    """Whether the look-alikes of a word stand in for Latin letters."""
    other = _char_class(list(look_alikes()))
    latin = word.rlike("\\p{IsLatin}")
    genuine = word.rlike(f"[\\p{{IsCyrillic}}\\p{{IsGreek}}&&[^{other[1:-1]}]]")
    letters = F.length(F.regexp_replace(word, "\\P{L}", ""))
    return F.when(latin, ~genuine).otherwise(~genuine & ~own_text & ((letters >= 2) | word.rlike("\\p{Nd}")))


def canonical(texts: DataFrame, col: str = "text") -> DataFrame:
    """text_key, canonical of each distinct suspicious text; a text without a row is canonical itself.

    text_key is the MD5 of the text, so that exploded rows needn't carry it.
    """
    spark = texts.sparkSession
    text = F.col(col)
    distinct = texts.where(suspicious(text)).select(text.alias("text")).distinct()
    other = _char_class(list(look_alikes()))
    # a text without Latin letters that has a word wholly in another script
    own = ~F.col("text").rlike("\\p{IsLatin}") & F.col("text").rlike(f"[\\p{{IsCyrillic}}\\p{{IsGreek}}&&[^{other[1:-1]}]]")
    words = distinct.select(F.unhex(F.md5("text")).alias("text_key"), own.alias("own"), F.posexplode(F.regexp_extract_all("text", F.lit("[^\\p{Z}\\s]+|[\\p{Z}\\s]"), F.lit(0))).alias("w", "word"))
    words = words.withColumn("folds", _look_folds(F.col("word"), F.col("own")))
    clusters = words.select("text_key", "w", "folds", F.posexplode(F.regexp_extract_all("word", F.lit("(?s).\\p{M}*"), F.lit(0))).alias("c", "cluster"))
    points = clusters.select("text_key", "w", "folds", "c", F.posexplode(F.regexp_extract_all("cluster", F.lit("(?s)."), F.lit(0))).alias("p", "ch"))
    hit = points.join(F.broadcast(mapping(spark)), "ch", "left")  # the mapping has a fixed size
    keep = F.col("to").isNull() | (F.col("look") & ~F.col("folds"))
    parts = hit.withColumn("to", F.when(keep, F.array(F.struct(F.col("ch").alias("out"), F.lit(0).alias("ccc")))).otherwise(F.col("to")))
    # a deleted character leaves its place, an empty starter, so that no position is lost
    parts = parts.select("text_key", "w", "c", "p", F.posexplode_outer("to").alias("s", "t"))
    order = F.struct("c", F.coalesce("t.ccc", F.lit(0)).alias("ccc"), "p", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t.out", F.lit("")).alias("out"))
    blocks = parts.groupBy("text_key", "w", (F.col("c") / 256).cast("int").alias("block")).agg(F.array_sort(F.collect_list(order)).alias("chars"))
    _, pairs = composites()
    pair_map = F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")

    def step(acc: Column, x: Column) -> Column:
        composed = pair_map[F.concat(acc["base"], x["out"])]
        starts = x["ccc"] == 0
        joins = ~starts & composed.isNotNull() & (acc["last"] < x["ccc"])
        return F.struct(
            F.when(starts, F.concat(acc["done"], acc["base"], acc["marks"])).otherwise(acc["done"]).alias("done"),
            F.when(starts, x["out"]).when(joins, composed).otherwise(acc["base"]).alias("base"),
            F.when(starts, F.lit("")).when(joins, acc["marks"]).otherwise(F.concat(acc["marks"], x["out"])).alias("marks"),
            F.when(starts | joins, F.when(starts, 0).otherwise(acc["last"])).otherwise(x["ccc"]).alias("last"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
    built = blocks.select("text_key", "w", "block", F.aggregate("chars", start, step, lambda a: F.concat(a["done"], a["base"], a["marks"])).alias("out"))
    return built.groupBy("text_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "block", "out"))), lambda x: x["out"]), "").alias("canonical"))


def with_canonical(df: DataFrame, col: str, to: str = "canonical") -> DataFrame:
    """df with the canonical form of a text column; distinct texts are mapped once."""
    forms = canonical(df, col).withColumnRenamed("canonical", "_canonical")
    key = F.when(suspicious(F.col(col)), F.unhex(F.md5(F.col(col))))
    joined = df.withColumn("text_key", key).join(forms, "text_key", "left")
    return joined.withColumn(to, F.coalesce("_canonical", F.col(col))).drop("text_key", "_canonical")


def values(tokens: DataFrame, grids: DataFrame, cases: DataFrame) -> DataFrame:
    """src, row_id, pos_a, pos_b, text of every value of the three tables."""
    a = tokens.select(F.lit("ocr_tokens").alias("src"), F.col("token_id").alias("row_id"), F.lit(0).alias("pos_a"), F.lit(0).alias("pos_b"), "text")
    b = grids.select("grid_id", F.posexplode("grid").alias("pos_a", "row")).select("grid_id", "pos_a", F.posexplode("row").alias("pos_b", "text"))
    b = b.select(F.lit("annotated_grids").alias("src"), F.col("grid_id").alias("row_id"), "pos_a", "pos_b", "text")
    c = cases.select("hard_case_id", F.posexplode("must_contain").alias("pos_a", "text"))
    c = c.select(F.lit("hard_cases").alias("src"), F.col("hard_case_id").alias("row_id"), "pos_a", F.lit(0).alias("pos_b"), "text")
    return a.unionByName(b).unionByName(c)


def found(tokens: DataFrame, grids: DataFrame, cases: DataFrame) -> DataFrame:
    """One distinct row per value that isn't in its canonical form.

    A hyphen or soft hyphen at the end of a recognised token divides a word at a
    line end and is left to that problem, unless something else differs too.
    """
    rows = values(tokens, grids, cases).where(suspicious(F.col("text")))
    divides = (F.col("src") == "ocr_tokens") & F.col("text").rlike(f"[{HYPHENS}]$")
    rows = rows.withColumn("text", F.when(divides, F.regexp_replace("text", f"[{HYPHENS}]$", "-")).otherwise(F.col("text")))
    changed = with_canonical(rows, "text").where("canonical <> text")
    return changed.select("src", "row_id", "pos_a", "pos_b").distinct()
