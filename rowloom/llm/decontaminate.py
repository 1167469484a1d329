"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of 8 words (all its words, if fewer). A window occurs in a document only if all its shingles do,
so a prefix of one shingle is enough to find it, if shingles are ordered by rarity: each window goes under its rarest shingle,
by counts over all documents. Documents look their shingles up among these; a candidate must leave room for the window before
and after it (positional and length bounds), and the whole window is then compared word by word.

Texts are never shuffled: only counts, hits and one short row for each document travel. The windows of all items are broadcast
while there are at most ``broadcast_windows`` of them, with at most BROADCAST_BYTES of text. Beyond, an array of bits (at most
MAX_BITS) tells at the scan which shingles can be in a window, and only places of such go, with their surroundings, to a join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, narrow, stored, with_key

WINDOW = 8
BROADCAST_BYTES = 32_000_000
MAX_BITS = 2**27
#: No word has one of these.
BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased, cut at runs of ASCII characters that are neither letters nor digits."""
    spaced = F.translate(text, string.ascii_uppercase + BETWEEN, string.ascii_lowercase + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def shingle(array: str, at: Column, size: int) -> Column:
    """Hash of ``size`` words from a position counted from 0; hits are compared word by word, so that collisions do no harm."""
    return F.xxhash64(*[F.get(F.col(array), at + i) for i in range(size)])


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, w): the distinct windows of each item; items without id or words have none."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("w")).distinct()


def bits_of(keys: DataFrame, bits: int) -> Column:
    """Which remainders mod ``bits`` (a power of 2) the keys have: a scalar array of bits / 64 longs."""
    at = keys.select(F.pmod("key", F.lit(bits)).alias("at"))
    found = at.groupBy(F.expr("at div 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("held"))
    spread = keys.sparkSession.range(bits // 64).select(F.col("id").alias("i")).join(found, "i", "left")
    one = spread.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("held", F.lit(0).cast("long")).alias("held")))).alias("all"))  # bits / 64 rows
    return stored(one.select(F.transform("all", lambda x: x["held"]).alias("held"))).scalar()


def found_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = 300_000) -> DataFrame:
    """(doc, row_key, start, size, item_id) for each occurrence of an item's window; start counts words from 0."""
    by_item = stored(windows(benchmark, window))
    distinct = by_item.select("w").distinct()
    n, shortest, volume = by_item.agg(F.count("*"), F.min(F.size("w")), F.sum(F.octet_length(F.concat_ws(" ", "w")))).first()
    small = n <= broadcast_windows and (volume or 0) <= BROADCAST_BYTES
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    size = min(2, shortest or 2)

    text = with_key(narrow(docs)).select(*KEY, words(F.col("text")).alias("words"))
    keys = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, size)]))
    held = distinct.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("offset")).select("w", "offset", shingle("w", F.col("offset"), size).alias("key"))
    wanted = held.select("key").distinct()
    if small:
        possible = lambda df: df
    else:
        bits = min(MAX_BITS, 1 << max(10, (8 * n * window).bit_length()))
        known = bits_of(wanted, bits)
        at = F.pmod("key", F.lit(bits))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
        possible = lambda df: df.where(F.get(known, F.floor(at / 64).cast("int")).bitwiseAND(one) != 0)
    counts = possible(text.select(F.explode(keys).alias("key"))).join(hint(wanted), "key").groupBy("key").agg(F.count("*").alias("n"))
    # a shingle that no document has rules its window out
    ranked = held.join(counts, "key", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("rarest")).where("rarest.n > 0")
    index = stored(ranked.select("w", "rarest.offset", "rarest.key"))

    placed = possible(text.select(*KEY, "words", F.posexplode(keys).alias("pos", "key")))
    if small:
        near = placed.withColumns({"n_words": F.size("words"), "from": F.lit(0)})
    else:
        low = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        near = placed.select(*KEY, "pos", "key", low.alias("from"), F.size("words").alias("n_words"), F.slice("words", low + 1, 2 * window).alias("words"))
    candidates = near.join(hint(index), "key").withColumn("start", F.col("pos") - F.col("offset"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.size("w") <= F.col("n_words"))
    same = F.slice("words", F.greatest(F.col("start") - F.col("from") + 1, F.lit(1)), F.size("w")) == F.col("w")
    hits = candidates.where(fits).where(same).select(*KEY, "start", F.size("w").alias("size"), "w")
    return hits.join(hint(by_item), "w").select(*KEY, "start", "size", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, broadcast_windows: int = 300_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items).

    n_hit counts words inside any occurrence of a window, items_sha256 is over the item_ids sorted as strings and joined by
    commas. Null and empty texts have no words; repeated rows each give a row; items without id or words are left out, repeated
    items count once; an empty benchmark contaminates nothing; further columns are ignored.
    """
    hits = found_windows(docs, benchmark, window, broadcast_windows)
    of_row = hits.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    judged = of_row.select(*KEY, F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", F.array_sort("items")).alias("items"))
    base = with_key(narrow(docs)).select("doc_id", *KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return base.join(judged, KEY, "left").select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_items", F.lit(0)) >= min_items).alias("contaminated"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """``docs`` without those that hold a full window of an item, or windows of ``min_items`` items; all columns kept.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark removes nothing; an empty table gives no
    rows; no column name is reserved.
    """
    hits = found_windows(docs, benchmark, window)
    leaked = hits.groupBy(*KEY).agg(F.max("size").alias("size"), F.count_distinct("item_id").alias("n")).where((F.col("size") >= window) | (F.col("n") >= min_items))
    rows, key = keyed(docs)
    return rows.join(leaked.select(*[F.col(c).alias(k) for c, k in zip(KEY, key)]), key, "left_anti").drop(*key)


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 7) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.s, pos.n, win.item_id FROM pos JOIN win ON pos.g = win.g),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
