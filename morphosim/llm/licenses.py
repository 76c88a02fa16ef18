"""License scans by canonical digests: whole texts, normalised, looked up by hash.

Normalising follows the public matching guidelines for licence texts: letter case,
punctuation, white space, comment marks, a title line and copyright lines don't count,
and varying spellings of whole words are equivalent. The digest of what remains is
joined with those of known texts. The known ones are a fixed list in
``_license_texts``, so they are broadcast; others can be given as a table of any size.

A copyright line is one that begins with "copyright" and goes on with a year, a mark or
a name, not one that a line break lets begin with "copyright notice", "copyright
holder" and the like; or one that begins with "(c)" and has a year, or with the sign.

Defined cases: null, empty and blank texts have the digest of the empty text and no
licence; a text of copyright lines or of a title only counts as empty; repeated rows are
each reported; a null doc_id is kept; very long texts are read whole; an empty table
gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._license_texts import DIGESTS, TEXTS
from ._shared import table

# Equivalent spellings, after case and punctuation are gone.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("authorise", "authorize"), ("authorised", "authorized"), ("organisation", "organization"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("per cent", "percent"), ("https", "http"), ("recognise", "recognize"), ("modernise", "modernize"),
)
LEAD = r"[ \t*#/;]*"
#: What follows "copyright" in a sentence, not in a notice.
SENTENCE = r"[ \t]*,?[ \t]*(notices?|holders?|owners?|laws?|licen[sc]es?|statements?|interests?|protection|treaty|treaties|rights?|permissions?|disclaimers?|status|works?|doctrines?|and|or|in|of|is|are|to|on|for)\b"
NOTICE_LINE = rf"(^|\n){LEAD}(copyright\b(?![ \t]*(\n|$))(?!{SENTENCE})|\(c\)[ \t]*copyright|\(c\)(?=[^\n]*[12][0-9]{{3}})|©)[^\n]*"
TITLE = r'^[\s*#/;]*(the[ \t]+)?(mit|mit no attribution|mit/x11|x11|expat|isc|zlib|zlib/libpng|json|curl|fair|postgresql|ntp|bsd|new bsd|modified bsd|revised bsd|simplified bsd|freebsd|bsd 1-clause|bsd 2-clause|bsd 3-clause|1-clause bsd|2-clause bsd|3-clause bsd|bsd 3-clause clear|clear bsd|university of illinois/ncsa open source)[ \t]+licen[sc]e([ \t]*\([^()\n]*\))?[ \t:]*(\n|$)'
RESERVED = r"all rights reserved\.?"
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """What of a text counts."""
    text = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), TITLE, "")
    text = F.regexp_replace(F.regexp_replace(text, NOTICE_LINE, "$1"), RESERVED, " ")
    text = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), MARKS, " ")
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(text)


def known(spark: SparkSession) -> DataFrame:
    """digest, license_id of each known text."""
    rows = spark.createDataFrame(list(TEXTS), "license_id string, text string")
    digests = rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").union(spark.createDataFrame(list(DIGESTS), "digest string, license_id string"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def lookup(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_chars, digest, license_id (null: none) of each document.

    ``licenses`` (digest, license_id) may be given, of any size; without, the fixed list is broadcast.
    """
    have = F.broadcast(known(docs.sparkSession)) if licenses is None else licenses
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("c"))
    digests = text.select("doc_id", F.length("c").cast("long").alias("canonical_chars"), F.sha2("c", 256).alias("digest"))
    return digests.join(have, "digest", "left").select("doc_id", "canonical_chars", "digest", "license_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql(text: str) -> str:
    """``canonical`` in SQL whose patterns can't look ahead: lines are judged one by one."""
    line = f"regexp_matches(l, {_quoted(f'^{LEAD}')} || "
    notice = (
        f"({line}'copyright\\b') AND NOT {line}'copyright[ \\t]*$') AND NOT {line}{_quoted('copyright' + SENTENCE)})) OR {line}'\\(c\\)[ \\t]*copyright')"
        f" OR {line}'\\(c\\).*[12][0-9][0-9][0-9]') OR {line}'©')"
    )
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(TITLE)}, '')"
    out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: CASE WHEN {notice} THEN '' ELSE l END), chr(10))"
    out = f"regexp_replace(' ' || regexp_replace({out}, {_quoted(RESERVED)}, ' ', 'g') || ' ', {_quoted(MARKS)}, ' ', 'g')"
    for other, one in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {one} ')"
    return f"trim({out})"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_quoted(x) for x in row) + ")" for row in rows)


ORACLE = f"""
WITH k AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({_sql("text")}) AS digest FROM (VALUES {_values(TEXTS)}) t(license_id, text) UNION ALL SELECT license_id, digest FROM (VALUES {_values(DIGESTS)}) t(digest, license_id)) GROUP BY 1),
d AS (SELECT doc_id, {_sql("text")} AS c FROM documents)
SELECT doc_id, length(c) AS canonical_chars, sha256(c) AS digest, license_id FROM d LEFT JOIN k ON k.digest = sha256(d.c)
"""
