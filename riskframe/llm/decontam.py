"""Benchmark decontamination by spaced-seed hashing.

A mask picks six token positions out of a short span and ignores the others.
Hashes of the picked tokens of benchmark items are joined with those of the
documents; a hit puts item and document on a diagonal, on which the windows
around the hit are verified token by token.  A document holds an item if some
window of ``WINDOW`` item tokens agrees in at least ``MATCHES`` of them, in
place, so up to two substituted tokens are tolerated.  The two masks are
lossless for that: whichever two of 13 tokens differ, one of them fits between,
and every window that agrees so far holds a hit.

Items of 9 to 12 tokens must agree in full; items with fewer tokens say too
little and match nothing.  Tokens are runs of letters and digits, lower-cased.

A seed carries the tokens around it, never its whole item, so work and memory
are linear in the lengths of items and documents.  The seeds are broadcast while
their measured size is at most ``BROADCAST_BYTES``.  Beyond, hashes and positions
alone are joined by shuffle, and only documents with a hit give their tokens.

Only DataFrame functions are used.  Cases: null and empty texts have no tokens
and hold nothing; documents of any length are searched whole; repeated
documents are each found, repeated items too; rows with a null id are kept
under null; empty tables give empty results; further columns pass through
:func:`remove_contaminated`.  A passage that a third of all documents share is
found by a map-side lookup and pre-aggregated before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import col, fresh_name

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SPAN = 9
WINDOW = 13
MATCHES = 11
#: Tokens before a hit that a window around it can reach.
REACH = WINDOW - min(m[-1] for m in MASKS) - 1
#: Positions handled as one block of a long text.
BLOCK = 64
#: Bytes of benchmark seeds, with the tokens around them, that are broadcast.
BROADCAST_BYTES = 64_000_000


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"),
                                F.lit(0))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with ``tokens`` in blocks: ``size`` (of all tokens), ``start`` (first
    position of the block), ``first`` and ``near`` (tokens from ``first`` on, as far
    as windows around the block's positions reach)."""
    first = lambda s: F.greatest(s - REACH, F.lit(0))
    block = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(BLOCK)), lambda s: F.struct(
        s.alias("start"), first(s).alias("first"),
        F.slice("tokens", first(s) + 1, s + BLOCK + WINDOW - 1 - first(s)).alias("near")))
    others = [c for c in rows.columns if c != "tokens"]
    return (rows.select(*others, F.size("tokens").alias("size"),
                        F.explode(F.when(F.size("tokens") >= SPAN, block)).alias("block"))
            .select(*others, "size", "block.*"))


def _seeds(blocks: DataFrame) -> DataFrame:
    """Explode blocks to their (at, seed): one row per position and mask that fits
    there."""
    at = F.col("at")
    placed = blocks.withColumn("at", F.explode(F.sequence(
        F.col("start"), F.least(F.col("start") + BLOCK, F.col("size")) - 1)))
    hashes = [F.when(at + mask[-1] < F.col("size"), F.xxhash64(
        F.lit(k), *[F.get("near", at - F.col("first") + o) for o in mask]))
        for k, mask in enumerate(MASKS)]
    return placed.withColumn("seed", F.explode(F.array(*hashes)))


def _around(at: Column) -> Column:
    """Tokens from ``REACH`` before ``at``, or the start, as far as windows reach."""
    lead = F.least(at, F.lit(REACH))
    return F.slice("near", at - lead - F.col("first") + 1, lead + WINDOW)


def _best_window(near: Column, at: Column, item_near: Column, item_at: Column,
                 item_size: Column) -> Column:
    """Most agreeing tokens in a window of the item that lies within the reach of a
    hit; null: none agrees far enough."""
    lead, item_lead = F.least(at, F.lit(REACH)), F.least(item_at, F.lit(REACH))
    # the item's tokens facing the document's, one entry an item token
    same = F.transform(item_near, lambda x, i: F.coalesce(
        (F.get(near, i - item_lead + lead) == x).cast("int"), F.lit(0)))
    width = F.least(item_size, F.lit(WINDOW))
    sums = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(item_near) - width + 1, F.lit(1))),
        lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda n, x: n + x))
    best = F.array_max(sums)
    return F.when(best >= F.when(item_size < WINDOW, item_size).otherwise(MATCHES), best)


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text",
             item: str = "item_id", item_text: str = "text",
             broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document key and item held: ``keys``, ``item``, ``n_match``
    (most agreeing tokens in a window) and ``diagonal`` (first token of the
    document that faces the item's start, smallest if several)."""
    clash = {item, "n_match", "diagonal"} & set(keys)
    if clash:
        raise ValueError(f"keys clash with result columns {sorted(clash)}")
    items = (benchmark.select(col(item).alias("item"), tokens_of(col(item_text)).alias("tokens"))
             .where(F.size("tokens") >= SPAN))
    bench = (_seeds(_blocks(items)).where("seed is not null")
             .select("seed", "item", F.col("at").alias("item_at"), F.col("size").alias("item_size"),
                     _around(F.col("at")).alias("item_near")))
    size = bench.agg(F.sum(F.octet_length(F.array_join("item_near", "")) + F.lit(64)
                           + 16 * F.size("item_near"))).first()[0] or 0
    names = [f"k{i}" for i in range(len(keys))]
    rows = _blocks(docs.where(col(text).isNotNull()).select(
        *[col(k).alias(n) for k, n in zip(keys, names)], tokens_of(col(text)).alias("tokens")))
    if size <= broadcast_bytes:
        hits = _seeds(rows).join(F.broadcast(bench), "seed")
    else:
        found = (_seeds(rows).where("seed is not null").select(*names, "seed", "at")
                 .join(bench, "seed").drop("seed").dropDuplicates([*names, "item", "at", "item_at"]))
        block = F.col("at") - F.col("at") % BLOCK
        same = [F.col(f"d.{n}").eqNullSafe(F.col(f"f.{n}")) for n in names]
        hits = (found.withColumn("block", block).alias("f")
                .join(rows.alias("d"), [F.col("d.start") == F.col("f.block"), *same])
                .select("f.*", "d.first", "d.near"))
    best = _best_window(_around(F.col("at")), F.col("at"), F.col("item_near"),
                        F.col("item_at"), F.col("item_size"))
    # no filter on the verified count before the aggregate: it would enter the
    # join, whose rows hold token arrays, and take it out of generated code
    return (hits.withColumn("diagonal", F.col("at") - F.col("item_at")).withColumn("n_match", best)
            .groupBy(*names, "item")
            .agg(F.max("n_match").alias("n_match"),
                 F.min(F.when(F.col("n_match").isNotNull(), F.col("diagonal"))).alias("diagonal"))
            .where("n_match is not null")
            .select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("item").alias(item),
                    F.col("n_match").cast("long").alias("n_match"),
                    F.col("diagonal").cast("long").alias("diagonal")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                        item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    key = fresh_name(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(col(text), 256))
    held = overlaps(keyed, benchmark, [key], text, item, item_text).select(key).distinct()
    return keyed.join(held, key, "left_anti").drop(key)
