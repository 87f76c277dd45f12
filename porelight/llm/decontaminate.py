"""Benchmark decontamination: size-partitioned MinHash containment search; DataFrame functions only.

A test item is short and a document long, so their Jaccard similarity is tiny
and a MinHash signature of the document would not meet the item's. The search
therefore asks for containment, which depends on the item's shingles alone:

1. Items are partitioned by the number ``n`` of their distinct shingles, by
   powers of two. With the partition's upper bound ``u``, an item's signature is
   its ``u - ceil(t * u) + 1`` shingles of least hash (all, if it has fewer).
2. If a document contains a share ``t`` of the item, it lacks at most
   ``n - ceil(t * n)`` of its shingles, so it contains one of the signature: the
   search finds every leak. A document is a candidate of an item when one of its
   shingles is in the signature.
3. Candidates are verified by counting the distinct shingles of the item, as
   texts and not as hashes, that the document contains.

Texts are not shuffled: each document's shingles are looked up where the document
is read, against signatures that are broadcast if their counted number is within
``max_broadcast`` and joined by a shuffle of hashes beyond it. Candidates are read
again where they lie, by a broadcast of their keys; only if these are more than
the bound of ``common.bounded`` do texts meet them by a shuffle. A row's key is its
id and a hash of id and text.

Defined results: texts are lower-cased; an item with fewer words than a shingle
is one shingle of its own length, found wherever a document has these words in a
row: documents are cut into shingles of each length that occurs among the items,
at most ``k`` lengths. An item without a word is never found; null texts are empty;
a leak is returned once however often the same row is repeated; rows with one id
(or none) and different texts are searched, and searched for, each on its own; an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from porelight.llm.common import bounded, durable, fresh

BLANK = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANK)), "[ \\t\\n\\x0B\\f\\r]+")


def shingles(rows: DataFrame, keep: list[str], text_col: str, lengths: Column, k: int) -> DataFrame:
    """``keep`` and one row per shingle of each length: h, its hash, and the words it is made of, still apart.

    ``lengths`` is an array of numbers of words up to ``k``, which may use ``w``, the words of a text.
    """
    words = rows.select(*keep, _words(F.col(text_col)).alias("w")).where("w[0] != ''")
    cut = words.select(*keep, "w", F.explode(lengths).alias("k")).where("size(w) >= k")
    each = cut.select(*keep, "w", "k", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("i"))
    parts = [F.when(F.col("k") > j, F.get("w", F.col("i") + j)) for j in range(k)]  # nulls are neither hashed nor joined
    return each.select(*keep, F.xxhash64(*parts).alias("h"), F.concat_ws(" ", *parts).alias("shingle"))


def item_signatures(items: DataFrame, item_col: str, text_col: str, k: int, t: float) -> DataFrame:
    """(item, row, n, size, h, shingle, in_signature) for every distinct shingle of every item; ``row`` is a hash of id and text, ``size`` the words of a shingle."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("item", "text"))
    own = shingles(rows, ["item", "row"], "text", F.array(F.least(F.size("w"), F.lit(k))), k).distinct()
    item = Window.partitionBy("item", "row")
    ranked = own.withColumn("n", F.count("*").over(item)).withColumn("rank", F.row_number().over(item.orderBy("h", "shingle")))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    return ranked.select("item", "row", "n", F.size(F.split("shingle", " ")).alias("size"), "h", "shingle", (F.col("rank") <= upper - F.ceil(upper * F.lit(t) - F.lit(1e-9)) + 1).alias("in_signature"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, t: float = 0.8, max_broadcast: int = 1_000_000) -> DataFrame:
    """(id, item_id, n_shingles, n_found, containment) for every item of which a document contains a share ``t`` or more."""
    return _leaks(docs, items, id_col, text_col, item_col, item_text_col, k, t, max_broadcast).select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment")).distinct()


def _row_key() -> Column:
    return F.xxhash64("id", "text")


def _leaks(docs, items, id_col, text_col, item_col, item_text_col, k, t, max_broadcast) -> DataFrame:
    own = durable(item_signatures(items, item_col, item_text_col, k, t))
    small = F.broadcast if own.count() <= max_broadcast else (lambda df: df)
    lengths = F.array(*(F.lit(r[0]) for r in sorted(own.select("size").distinct().collect()))).cast("array<int>")  # at most k
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", _row_key())
    met = shingles(rows, ["id", "key"], "text", lengths, k).join(small(own.where("in_signature").select("item", "row", "h", F.col("shingle").alias("known"))), "h")
    candidates = durable(met.where("shingle = known").select(F.col("id").alias("doc"), "key", "item", "row").distinct())
    wanted = bounded(durable(candidates.select("doc", F.col("key").alias("wanted")).distinct()))
    again = rows.join(wanted, (F.col("key") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("doc")), "left_semi")
    found = shingles(again, ["id", "key"], "text", lengths, k).join(small(own.select("item", "row", "n", "h", F.col("shingle").alias("known"))), "h").where("shingle = known")
    counted = found.groupBy("id", "key", "item", "row", "n").agg(F.countDistinct("shingle").alias("n_found"))
    same = counted["id"].eqNullSafe(candidates["doc"]) & (counted["key"] == candidates["key"]) & counted["item"].eqNullSafe(candidates["item"]) & (counted["row"] == candidates["row"])
    return counted.where(F.col("n_found") >= F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9))).join(candidates, same, "left_semi")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, t: float = 0.8, max_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    key, own = fresh(docs, "leak_key"), fresh(docs, "leak_id")
    leaked = _leaks(docs, items, id_col, text_col, item_col, item_text_col, k, t, max_broadcast).select(F.col("id").alias(own), F.col("key").alias(key)).distinct()
    leaked, keyed = bounded(durable(leaked)), docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    return keyed.join(leaked, (keyed[key] == leaked[key]) & keyed[id_col].eqNullSafe(leaked[own]), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(k: int = 5, t: float = 0.8) -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def words(table: str, id_col: str) -> str:
        return f"SELECT {id_col}, text, string_split_regex(trim(lower(coalesce(text, '')), {blank}), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM {table}"

    def cut(source: str) -> str:
        return f"SELECT DISTINCT * EXCLUDE (w, k, i), array_to_string(w[i : i + k - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM {source} WHERE w[1] <> '' AND len(w) >= k)"

    return f"""
WITH bw AS (SELECT *, least(len(w), {k}) AS k FROM ({words("benchmark", "item_id")})),
dw AS (SELECT * FROM ({words("documents", "doc_id")}), (SELECT DISTINCT k FROM bw)),
d AS ({cut("dw")}), b AS ({cut("bw")}),
n AS (SELECT item_id, text, count(*) AS n_shingles FROM b GROUP BY ALL)
SELECT DISTINCT d.doc_id, b.item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN b USING (shingle) JOIN n ON n.item_id IS NOT DISTINCT FROM b.item_id AND n.text = b.text
GROUP BY d.doc_id, d.text, b.item_id, b.text, n_shingles HAVING count(*) >= ceil({t} * n_shingles - 1e-9)
"""
