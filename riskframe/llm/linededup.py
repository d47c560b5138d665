"""Cross-site boilerplate removal by the distinct-site spread of lines.

Each line hash gets a HyperLogLog sketch of the sites it appears on; sketches
merge by aggregation, so a line that a third of all documents share costs one
small sketch per task.  Lines whose estimate lies within ``margin`` of the
threshold are counted exactly.  Lines on at least ``min_sites`` sites are
boilerplate and leave their documents.

Boilerplate leaves every document, whatever its share of it.  Only a text of
nothing but boilerplate that has a near copy of the same kind (five-word
shingles, similarity 0.8) stays whole: it is a copied document, for
document-level dedup to keep one of, not a page of repeated lines.

Cases: a null text stays null and has no lines; blank lines are never
boilerplate; a null site counts for no line; repeated rows count once per
site; a line repeated within a document leaves at each place; an empty table
gives an empty result; further columns pass through, and one named like a result
is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import ngramjoin
from riskframe.llm.common import col, fresh_name, shared_table

MIN_SITES = 5
#: Relative band around the threshold that is counted exactly: about six standard
#: errors of a sketch with 2^12 registers.
MARGIN = 0.1
SKETCH_BITS = 12


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """64-bit hash of a line; null for a blank line."""
    return F.when(F.length(F.trim(line)) > 0, F.xxhash64(line))


def _line_sites(docs: DataFrame, text: str, site: str) -> DataFrame:
    hashes = F.array_distinct(F.transform(line_array(col(text)), line_hash))
    return (docs.where(col(text).isNotNull() & col(site).isNotNull())
            .select(F.explode(hashes).alias("line"), col(site).cast("string").alias("site"))
            .where("line is not null"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source",
                min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(line, sites) of the lines on at least ``min_sites`` sites, written to the
    shared folder.

    The lines in question are written before they are joined to all lines:
    Spark then broadcasts them by their measured size or, where they are too
    many, splits the share of a line that very many documents hold."""
    lines = _line_sites(docs, text, site)
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    spread = shared_table(lines.groupBy("line")
                          .agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
                          .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
                          .where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select("line")
    exact = (lines.join(near, "line", "left_semi")
             .groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count("*").alias("sites"))
             .where(F.col("sites") >= min_sites))
    return shared_table(spread.where(F.col("sites") > high).unionByName(exact))


def _copies(found: DataFrame, key: str, text: str, hit: str) -> DataFrame:
    """Keys of the texts of boilerplate only that have a near copy among them."""
    bare = F.forall(line_array(col(text)), lambda x: (F.length(F.trim(x)) == 0)
                    | F.array_contains(col(hit), F.xxhash64(x)))
    emptied = found.where(bare).select(col(key).alias("doc_id"), col(text).alias("text"))
    return (ngramjoin.near_duplicates(emptied).where("n_links > 0")
            .select(F.col("doc_id").alias(key)).distinct())


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source",
                       min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``, plus
    ``n_lines`` and ``n_removed``.

    Lines are looked up once per distinct text: the hits come back keyed by the
    text's hash, so texts travel once and lines only as hashes."""
    key, hit, plan = (fresh_name(docs, n) for n in ("text_key", "hit", "plan"))
    keyed = docs.withColumn(key, F.sha2(col(text), 256))
    found = boilerplate(docs, text, site, min_sites, margin).select("line")
    lines = (keyed.where(col(text).isNotNull())
             .select(col(key), F.explode(F.array_distinct(
                 F.transform(line_array(col(text)), line_hash))).alias("line"))
             .where("line is not null"))
    # written as well: a text that very many rows repeat can be split in the join
    hits = shared_table(lines.join(found, "line", "left_semi")
                        .groupBy(col(key)).agg(F.collect_set("line").alias(hit)))
    hits = hits.join(_copies(keyed.join(hits, key), key, text, hit), key, "left_anti")
    joined = keyed.join(hits, key, "left")
    all_lines = line_array(col(text))
    kept = F.filter(all_lines, lambda x: ~F.coalesce(
        F.array_contains(col(hit), F.xxhash64(x)), F.lit(False)) | (F.length(F.trim(x)) == 0))
    planned = joined.withColumn(plan, F.when(col(hit).isNotNull(), kept))
    acts = col(plan).isNotNull()
    n_lines = F.when(col(text).isNotNull(), F.size(all_lines)).otherwise(0)
    out = [F.when(acts, F.array_join(col(plan), "\n")).otherwise(col(text)).alias(c)
           if c == text else col(c) for c in docs.columns
           if c.lower() not in ("n_lines", "n_removed")]
    return planned.select(
        *out, n_lines.cast("long").alias("n_lines"),
        F.when(acts, n_lines - F.size(col(plan))).otherwise(0).cast("long")
        .alias("n_removed"))
