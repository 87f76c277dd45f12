"""Licence scans by canonical digests; DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, everything but letters and digits turned into
single spaces. Its SHA-256 is joined by hash to the digests of known licences,
so a lookup costs the same for any number of licences. Two kinds of entire texts
are looked up: the document itself, and each of its lines, since corpora carry
licences mostly as a notice of one line.

Defined results: null and blank texts, and texts of copyright lines alone, match
nothing; repeated rows are each returned; several licences with the same
canonical text all match, in the order of their ids; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelight.llm.license_texts import DIGESTS, notices

#: Copyright lines, as they stand in lower-cased text.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"

#: Spellings that licence texts use alike, as (pattern, canonical form).
SPELLINGS = (
    ("licence", "license"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("share-alike", "sharealike"), ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("organis", "organiz"), ("recognis", "recogniz"), ("initialis", "initializ"), ("programme", "program"), ("judgement", "judgment"), ("fulfil ", "fulfill "), ("wilful", "willful"), ("https:", "http:"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("and/or", "or"), ("version ", ""), ("v2", "2"), ("v3", "3"),
)


def canonical(text: str) -> str:
    """The form of a known licence; the same as ``canonical_column``."""
    text = re.sub(COPYRIGHT, "", text.lower())
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return re.sub(r"[\W_]+", " ", text).strip(" ")


def canonical_column(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def known_digests(known: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(digest, ids): sorted ids of the licences that share a canonical text."""
    by: dict[str, set[str]] = {} if known else {digest: {license_id} for license_id, digest in DIGESTS.items()}
    for license_id, text in known or notices():
        if form := canonical(text):
            by.setdefault(hashlib.sha256(form.encode()).hexdigest(), set()).add(license_id)
    return sorted((d, ",".join(sorted(ids))) for d, ids in by.items())


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """Per row: id, text_license (ids if the whole text is a licence, else ''), line_licenses (distinct ids of its lines), n_license_lines."""
    digests = known_digests(known)
    table = docs.sparkSession.createDataFrame(digests, "digest string, ids string")
    small = F.broadcast if len(digests) <= max_broadcast else (lambda df: df)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the whole text is line 0; the rows of a document are put together in their task, before any shuffle
    units = rows.withColumn("row", F.monotonically_increasing_id()).select(F.struct("id", "row").alias("doc"), F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line", "unit"))
    hits = units.withColumn("digest", F.sha2(canonical_column(F.col("unit")), 256)).join(small(table), "digest", "left")
    whole = F.max(F.when(F.col("line") == 0, F.col("ids")))
    lines = F.when(F.col("line") > 0, F.col("ids"))
    found = hits.groupBy("doc").agg(whole.alias("whole"), F.collect_set(lines).alias("lines"), F.count(lines).alias("n"))
    each = F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda x: F.split(x, ",")))))
    return found.select(F.col("doc.id").alias(id_col), F.coalesce("whole", F.lit("")).alias("text_license"), F.array_join(each, ",").alias("line_licenses"), F.col("n").alias("n_license_lines"))


def oracle(known: list[tuple[str, str]] | None = None) -> str:
    form = f"regexp_replace(lower(unit), '{COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        form = f"replace({form}, '{a}', '{b}')"
    form = f"trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    values = ", ".join(f"('{d}', '{ids}')" for d, ids in known_digests(known))
    return f"""
WITH known(digest, ids) AS (VALUES {values}),
units AS (
  SELECT doc_id, 0 AS line, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, 1, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
), hits AS (SELECT doc_id, line, known.ids FROM units LEFT JOIN known ON known.digest = sha256({form})),
each AS (SELECT DISTINCT doc_id, unnest(string_split(ids, ',')) AS license FROM hits WHERE line = 1 AND ids IS NOT NULL),
listed AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS line_licenses FROM each GROUP BY doc_id)
SELECT doc_id, coalesce(max(CASE WHEN line = 0 THEN ids END), '') AS text_license, coalesce(any_value(line_licenses), '') AS line_licenses,
  count(CASE WHEN line = 1 THEN ids END) AS n_license_lines
FROM hits LEFT JOIN listed USING (doc_id) GROUP BY doc_id
"""
