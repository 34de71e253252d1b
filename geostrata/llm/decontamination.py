"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is a fixed mask over consecutive words: the words at its positions are hashed, the others are
ignored, so a hit survives substitutions at ignored positions. The seeds of all benchmark items are
joined with the seeds at every position of every document. Around a hit, item and document are laid on
each other along the hit's diagonal, and some window of 13 item words must agree in at least 11. The
mask hits every such window: for any two substitutions among 13 words it still fits somewhere
(``tests/llm`` verifies this over all pairs), so nothing is lost against a brute-force search.

Items of fewer than 13 words must agree in all words; those shorter than a mask get a contiguous mask
of their own length. The items' seeds, each with its item's words, are broadcast after their bytes are
summed; beyond the bound the seeds are joined by a shuffle and the hits are verified after joins by row numbers.

Nulls and texts without words: never a hit. Null ids are ids like others. Repeated rows: one row for a pair
of ids, with the best window. Very long texts: every position has its seed. Empty tables: no rows. Other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.session import materialize

#: Positions of the mask. It hits every window of 13 words with up to two substitutions.
MASKS = ((0, 1, 3, 6, 7),)
WINDOW, LEAST = 13, 11
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the seeds' rows, each with its item's words, up to which they are broadcast.
MAX_BROADCAST_BYTES = 64_000_000


def word_hashes(text: Column) -> Column:
    """The lower-cased words of a text, hashed to 64 bits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column, mask: tuple[int, ...]) -> Column:
    """The hash of the words at the mask's positions, for every place where the mask fits."""
    last = F.size(words) - F.lit(mask[-1] + 1)
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + F.lit(m)) for m in mask]))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def best_window(doc: Column, item: Column, start: Column) -> Column:
    """The most words that agree in a window of the item laid on the document at start."""
    same = F.transform(item, lambda x, i: F.coalesce(F.when(start + i >= 0, F.get(doc, start + i) == x), F.lit(False)).cast("int"))
    width = F.least(F.lit(WINDOW), F.size(item))
    first = F.sequence(F.lit(1), F.size(item) - width + F.lit(1))
    return F.array_max(F.transform(first, lambda s: F.aggregate(F.slice(same, s, width), F.lit(0), lambda a, x: a + x)))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of documents and items that they leak: doc_id, item_id, n_equal (words equal in the best window)."""
    items = items.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("item"))
    items = items.withColumn("n_item", F.size("item")).where(F.col("n_item") > 0).withColumn("item_row", F.monotonically_increasing_id())
    short = [r[0] for r in items.where(F.col("n_item") <= MASKS[0][-1]).select("n_item").distinct().collect()]
    masks = [*MASKS, *[tuple(range(k)) for k in sorted(short)]]
    texts = docs.select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("doc"))

    def at_all(rows: DataFrame, words: str, place: str) -> DataFrame:
        if len(masks) == 1:
            return rows.select("*", F.lit(0).alias("mask"), F.posexplode(seeds(F.col(words), masks[0])).alias(place, "seed"))
        # all masks at once, so that a text's words are found and hashed once
        row = lambda k: lambda s, i: F.struct(F.lit(k).alias("mask"), i.alias(place), s.alias("seed"))
        return rows.select("*", F.inline(F.concat(*[F.transform(seeds(F.col(words), m), row(k)) for k, m in enumerate(masks)])))

    wanted = at_all(items.drop("n_item"), "item", "item_at")
    size = wanted.agg(F.sum(F.size("item") * 8 + 64)).first()[0] or 0
    start = (F.col("doc_at") - F.col("item_at")).alias("start")
    if size <= MAX_BROADCAST_BYTES:
        hits = at_all(texts, "doc", "doc_at").join(F.broadcast(wanted.drop("item_row")), ["mask", "seed"]).select("doc_id", "item_id", "doc", "item", start)
    else:
        # words are hashed once, and rows are told apart by numbers of their own, whatever ids they share or lack
        texts = materialize(texts.where(F.size("doc") > 0).withColumn("doc_row", F.monotonically_increasing_id()), "leak-texts")
        items = materialize(items, "leak-items")
        wanted = at_all(items.select("item", "item_row"), "item", "item_at")
        at = at_all(texts.select("doc", "doc_row"), "doc", "doc_at").drop("doc").join(wanted.drop("item"), ["mask", "seed"]).select("doc_row", "item_row", start).distinct()
        hits = at.join(items.select("item_row", "item_id", "item"), "item_row").join(texts, "doc_row")
    judged = hits.withColumn("n_equal", best_window(F.col("doc"), F.col("item"), F.col("start")))
    enough = F.col("n_equal") >= F.when(F.size("item") >= WINDOW, F.lit(LEAST)).otherwise(F.size("item"))
    return judged.where(enough).groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"))


def leaks_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same pairs in DuckDB SQL, for items of at least 13 words or short ones in full."""
    key = lambda w, mask, at: " || ' ' || ".join(f"{w}[{at} + {m + 1}]" for m in mask)
    part = lambda t, i: " UNION ALL ".join(
        f"SELECT {i}, {k} AS mask, p AS pos, {key('w', m, 'p')} AS seed FROM (SELECT *, unnest(range(0, len(w) - {m[-1]})) AS p FROM {t})" for k, m in enumerate(MASKS)
    )
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
    b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {benchmark}),
    ds AS ({part('d', 'doc_id')}),
    bs AS ({part('b', 'item_id')}),
    hit AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS start FROM ds JOIN bs USING (mask, seed)),
    laid AS (SELECT doc_id, item_id, len(b.w) AS n, least({WINDOW}, len(b.w)) AS width,
               list_transform(range(0, len(b.w)), lambda i: CASE WHEN start + i >= 0 AND d.w[start + i + 1] = b.w[i + 1] THEN 1 ELSE 0 END) AS eq
             FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
    win AS (SELECT doc_id, item_id, n, list_max(list_transform(range(0, n - width + 1), lambda s: list_sum(eq[s + 1 : s + width]))) AS n_equal FROM laid)
    SELECT doc_id, item_id, max(n_equal)::INTEGER AS n_equal FROM win
    WHERE n_equal >= CASE WHEN n >= {WINDOW} THEN {LEAST} ELSE n END GROUP BY doc_id, item_id"""
