"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A text is the set of its five-word shingles (words are runs of letters and
digits, lower-cased; a text of fewer words is one shingle).  Texts with equal
sets are one class.  Every class has a MinHash signature per tree; a tree is
the prefix trie of its sorted signatures, and two classes meet in a tree when
they share a node of the matched depth.  That depth starts at full length and
is shortened until the trees together reach the target recall for pairs at the
threshold, where it is lowest.  Classes that meet, directly or over others, are
a candidate cell; within a cell every pair is verified on its whole shingle
sets, in blocks of bounded size.

The result counts links and names groups; pairs are never listed, so a group
of near copies costs its blocks and one row per member.

Cases: a null text or one without a word has no shingle, links with nothing
and is a group of its own; copies (also repeated rows) link with each other;
ties between representatives go to the smallest id, then the first row, null
ids last; texts of any length count whole; an empty table gives an empty
result; further columns pass through and must not be named like the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.blocks import block_rows, per_block, roots
from riskframe.llm.common import col, map_arrow, shared_table
from riskframe.llm.components import components
from riskframe.llm.links import grouped
from riskframe.llm.words import parts

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
TARGET_RECALL = 0.9999
SEED = 11
#: Shingles and rows that a chunk of a cell aims at; a block compares all rows of
#: two chunks in dense arrays.
CHUNK_SHINGLES = 400_000
CHUNK_ROWS = 1024
#: Representatives (8 bytes each) up to which their row numbers are broadcast.
BROADCAST_ROWS = 2_000_000
#: Word hashes that a task keeps at hand.
KEPT_WORDS = 150_000

_WORD = re.compile(r"[^\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                  target: float = TARGET_RECALL) -> int:
    """Longest matched prefix whose expected recall at the threshold reaches
    the target: the full depth, shortened as long as it does not."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


class Shingler:
    """Shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.kept = words, {}

    def sets(self, text: str | None) -> np.ndarray:
        """Distinct 64-bit shingle hashes, sorted."""
        found = _WORD.findall(text.lower()) if text else []
        if not found:
            return np.empty(0, dtype=np.uint64)
        kept = self.kept
        try:
            h = np.array([kept[w] for w in found], dtype=np.uint64)
        except KeyError:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for w in found:
                if w not in kept:
                    kept[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([kept[w] for w in found], dtype=np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = (out ^ h[k:len(h) - n + 1 + k]) * _M
            out ^= out >> np.uint64(29)
        return np.unique(out)


class Signer:
    """MinHash signatures: one 16-bit value per function."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, size, dtype=np.uint32)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(x), 512):
            values = x[at:at + 512, None] * self.a + self.b
            np.minimum(least, values.min(axis=0), out=least)
        # the order was linear in x; scramble before cutting to 16 bits
        return ((least * np.uint32(2_654_435_761)) >> np.uint32(16)).astype(np.uint16)


def _signed(docs: DataFrame, text: str, words: int, trees: int, depth: int, seed: int) -> DataFrame:
    """``docs`` with class hash, number of shingles and a prefix hash per tree."""
    names = docs.columns

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(trees * depth, seed)
        for batch in batches:
            for part in parts(batch, len(names)):
                a, b, n, prefixes = [], [], [], []
                for t in part.column(len(names)).to_pylist():
                    s = shingler.sets(t)
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    a.append((h >> 64) - 2**63)
                    b.append((h & (2**64 - 1)) - 2**63)
                    n.append(len(s))
                    prefixes.append([xxhash.xxh3_64_intdigest(p.tobytes(), k) - 2**63 for k, p in
                                     enumerate(signer.sign(s).reshape(trees, depth))]
                                    if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                    [f"c{i}" for i in range(len(names) + 4)])

    types = [f.dataType for f in docs.schema.fields] + [
        T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType())]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    given = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)],
                        col(text).alias("t"))
    return map_arrow(given, sign, schema)


def _verifier(words: int, threshold: float):
    """Links within a block: exact Jaccard over whole shingle sets."""
    def judge(rows: pa.Table) -> pa.RecordBatch | None:
        shingler = Shingler(words)
        node = rows["node"].to_numpy()
        copies = rows["copies"].to_numpy()
        side, i, j = rows["side"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py()
        sets = [shingler.sets(t) for t in rows["text"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
        shared = seen[column] > 1                     # the others meet nothing
        owner = owner[shared]
        _, column = np.unique(column[shared], return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, (start, start + 4096))
            x = np.zeros((len(sets), 4096), dtype=np.float32)
            x[owner[lo:hi], column[lo:hi] - start] = 1
            common += x @ x.T
        linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= side[:, None] != side[None, :]
        root = roots(linked)
        links = linked @ copies
        keep = links > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(node[keep]), pa.array(links[keep].astype(np.int64)),
             pa.array(node[root][keep])], ["node", "links", "root"])
    return judge


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES,
                    depth: int = DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """``docs`` plus ``class_id`` (smallest key of the group), ``n_links``
    (other rows with similarity at the threshold or above) and ``kept`` (the
    one row of its group that stays)."""
    names = docs.columns
    clash = {"class_id", "n_links", "kept"} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"the input already has the result columns {sorted(clash)}")
    matched = matched_depth(threshold, trees, depth, target)
    signed = shared_table(_signed(docs, text, words, trees, matched, SEED)
                          .toDF(*[f"c{i}" for i in range(len(names))], "a", "b", "n", "prefixes")
                          .withColumn("row", F.monotonically_increasing_id()))
    id_col, text_col = f"c{names.index(key)}", f"c{names.index(text)}"
    # the smallest key wins, null keys last, then the first row
    best = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("id"), F.col("row"))
    slim = signed.where("n > 0").select("a", "b", "n", "row", best.alias("best"))
    classes = shared_table(slim.groupBy("a", "b").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.min("best").alias("best"),
        F.first("n").alias("n")))
    n_classes = classes.count()
    picked = signed.select(F.col("row").alias("node"), F.col(text_col).alias("text"), "prefixes")

    def of(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
        return rows.join(F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes, "node")

    leaves = of(picked.drop("text"), classes.select("node"), n_classes).select(
        "node", F.posexplode("prefixes").alias("tree", "prefix"))
    meets = (leaves.groupBy("tree", "prefix").agg(F.count("*").alias("k"), F.min("node").alias("least"))
             .where("k > 1").drop("k"))
    edges = leaves.join(meets, ["tree", "prefix"]).select("node", "least")
    cells = components(edges, "node", "least")
    members = cells.unionByName(cells.select(F.col("root").alias("node"), "root")).distinct() \
        .withColumnRenamed("root", "cell")
    members = shared_table(members.join(classes.select("node", "copies", "n"), "node"))
    texts = of(picked.select("node", "text"), members, members.count())
    weight = F.greatest(F.col("n").cast("double"), F.lit(CHUNK_SHINGLES / CHUNK_ROWS))
    placed = block_rows(texts, ["cell"], "node", weight, CHUNK_SHINGLES)
    found = per_block(placed, ["cell"], ["node", "copies", "text"], _verifier(words, threshold),
                      "node bigint, links bigint, root bigint")
    result = grouped(classes, found)
    by_class = classes.select("a", "b", "node").join(result, "node").drop("node")
    rows = signed.drop("prefixes").join(by_class, ["a", "b"], "left")
    alone = F.col("n") == 0
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.when(alone, F.col(id_col)).otherwise(F.col("best.id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"))
