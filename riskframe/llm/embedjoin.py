"""Exact cosine range join of embeddings in metric cells.

On unit vectors a cosine of at least ``t`` is a distance of at most
``r = sqrt(2 - 2t)``.  Vectors of one label and length are a group; a large
group is partitioned by nearest pivots.  A vector visits the cell of another
pivot if a partner may be at home there: by the triangle inequality its distance
to that pivot exceeds the one to its own by no more than 2r (and, in Euclidean
space, it lies within r of the bisecting plane).

No vector is copied to the cells it visits.  Large groups are written once, in
the order of their cells; rounds of ``ROUND_BYTES`` of vectors are broadcast one
after the other, and the tasks compare them with the vectors of the same groups
that are not behind them in that order, cell by cell.  Groups of up to
``CELL_ROWS`` vectors are one block task each.  So every vector is shuffled at
most twice, at any size of the data, while the comparisons within a group that
pivots cannot prune stay quadratic.

Most pairs are told apart in single precision by a few principal axes: with
heads h and the lengths l of what the axes leave out, x.y <= h(x).h(y) + l(x)l(y).
The others are compared in full, in double precision.

Groups of up to ``CELL_ROWS`` vectors need no pivot, so at most ``MAX_PIVOTS``
pivots travel to the tasks at any size of the data.

Vectors link only when their labels are equal and not null.  Cases: vectors
that are null, empty, zero or hold null or non-finite components link with
nothing, nor do vectors of different lengths; equal vectors (128 bits of their
hash) are joined once and counted as often as they occur; repeated rows link
with each other; null ids are never the smallest of a component that has
another; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.blocks import per_block
from riskframe.llm.common import col, map_arrow, shared_table, slices
from riskframe.llm.links import grouped
from riskframe.session import drop_table

THRESHOLD = 0.93
#: Vectors that a cell aims at, and the most pivots of all groups together.
CELL_ROWS = 4096
MAX_PIVOTS = 4096
#: Vectors of either side that are compared at a time.
CHUNK_ROWS = 1024
#: Bytes of vectors that a round broadcasts.
ROUND_BYTES = 48 << 20
#: Slack on distances, far above rounding and far below any distance that counts.
SLACK = 1e-7
#: Share of pairs that the principal axes may leave to the full comparison.
UNDECIDED = 1e-4
#: Links held before they are joined into components.
EDGES = 1 << 17
#: Rounds whose results become one table.
MERGED = 16


def _normal(x: np.ndarray) -> np.ndarray:
    """Unit vectors of rows, in double precision."""
    # scaled by the largest component first: squares neither overflow nor vanish
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _screen(units: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Heads and lengths of the rest; with no axes the vectors themselves."""
    if axes is None:
        return units.astype(np.float32)
    head = units @ axes
    rest = np.sqrt(np.maximum(0.0, 1 - (head * head).sum(axis=1)))
    return np.column_stack([head, rest]).astype(np.float32)


def _screen_bound(width: int, threshold: float) -> np.float32:
    """What screens of linked vectors reach, rounding allowed for."""
    return np.float32(threshold - (width + 8) * 1.2e-7)


def _axes(x: np.ndarray, threshold: float) -> np.ndarray | None:
    """The fewest principal axes that decide nearly all pairs of a few rows, if
    that saves work; which ones are taken has no effect on the result."""
    length = x.shape[1]
    if length <= 16 or len(x) < 2:
        return None
    some = _normal(x[::max(1, len(x) // 1024)])
    vectors, units = np.linalg.svd(some[::2], full_matrices=False)[2].T, some[1::2]
    linked = (units @ units.T >= threshold).mean()
    k = 8
    while k < min(length - 8, vectors.shape[1]):
        screen = _screen(units, vectors[:, :k])
        if (screen @ screen.T >= _screen_bound(k + 1, threshold)).mean() - linked <= UNDECIDED:
            return np.ascontiguousarray(vectors[:, :k])
        k += max(8, k // 32 * 8)
    return None


def _nearest(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (units @ pivots.T).argmax(axis=1)


def _visits(units: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """Which cells may hold partners of each vector."""
    near = np.sqrt(np.maximum(0.0, 2 - 2 * units @ pivots.T))
    between = np.sqrt(np.maximum(0.0, 2 - 2 * pivots[home] @ pivots.T))
    own = near[np.arange(len(home)), home][:, None]
    triangle = near <= own + 2 * radius + SLACK
    plane = near ** 2 - own ** 2 <= 2 * radius * between + SLACK
    visits = triangle & plane
    visits[np.arange(len(home)), home] = True
    return visits


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of ``a`` and ``b``; ``label`` holds smallest members."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


@dataclass
class _Held:
    """Vectors of one group that others are compared with, ordered by cell and slice."""

    first: int                       # position of the first one among all groups held
    node: np.ndarray
    copies: np.ndarray
    x: np.ndarray
    cell: np.ndarray
    run: np.ndarray                  # slice of each one, ascending
    axes: np.ndarray | None
    screen: np.ndarray
    pivots: np.ndarray | None


def _held(first: int, node: np.ndarray, copies: np.ndarray, x: np.ndarray, cell: np.ndarray,
          run: np.ndarray, axes: np.ndarray | None, pivots: np.ndarray | None) -> _Held:
    order = np.lexsort([cell, run])
    x = x[order]
    screen = np.concatenate([_screen(_normal(x[a:a + CHUNK_ROWS]), axes)
                             for a in range(0, len(x), CHUNK_ROWS)])
    return _Held(first, node[order], copies[order], x, cell[order], run[order], axes, screen, pivots)


class _Meeting:
    """Links between the held vectors and those that meet them, by and by."""

    def __init__(self, rows: int, threshold: float):
        self.threshold = threshold
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.links = np.zeros(rows, np.int64)
        self.label = np.arange(rows)
        self.scores, self.hits = np.empty(0, np.float32), np.empty(0, bool)

    def _undecided(self, screen: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Flat positions of the pairs that may be linked."""
        n = len(screen) * len(held)
        words = -(-n // 8)
        if 8 * words > len(self.hits):
            self.scores, self.hits = np.empty(8 * words, np.float32), np.empty(8 * words, bool)
        np.matmul(screen, held.T, out=self.scores[:n].reshape(len(screen), len(held)))
        np.greater_equal(self.scores[:n], _screen_bound(screen.shape[1], self.threshold),
                         out=self.hits[:n])
        self.hits[n:8 * words] = False
        some = np.flatnonzero(self.hits[:8 * words].view(np.uint64) != 0)   # eight at a time
        word, at = np.nonzero(self.hits[:8 * words].reshape(-1, 8)[some])
        return some[word] * 8 + at

    def _pairs(self, units: np.ndarray, screen: np.ndarray, held: _Held, a: int,
               b: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of given vectors and the held ones from ``a`` to ``b``."""
        at = self._undecided(screen, held.screen[a:b])
        if len(at) * 32 > len(units) * (b - a):
            at = np.flatnonzero(units @ _normal(held.x[a:b]).T >= self.threshold)
            i, j = np.divmod(at, b - a)
            return i, j + a
        i, j = np.divmod(at, b - a)
        j += a
        some = max(1, (1 << 20) // units.shape[1])
        linked = [np.einsum("ij,ij->i", units[i[k:k + some]], _normal(held.x[j[k:k + some]]))
                  >= self.threshold for k in range(0, len(i), some)]
        keep = np.concatenate(linked) if linked else np.zeros(0, bool)
        return i[keep], j[keep]

    def meet(self, held: _Held, node: np.ndarray, copies: np.ndarray, x: np.ndarray,
             home: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the given vectors to held ones of their own slice and of those
        before it, and one that each links to (or -1).  Links across slices count
        for both; those within one are met from either side."""
        links, root = np.zeros(len(node), np.int64), np.full(len(node), -1)
        units = _normal(x)
        screen = _screen(units, held.axes)
        visits = None if held.pivots is None else _visits(units, home, held.pivots, self.radius)
        met = int(np.searchsorted(held.run, run.max(), side="right"))
        cuts = [0, *(np.flatnonzero(np.diff(held.cell[:met])) + 1).tolist(), met]
        edges, waiting = [], 0
        for start, end in zip(cuts, cuts[1:]):
            if visits is None:
                who, u, s = np.arange(len(node)), units, screen
            else:
                who = np.flatnonzero(visits[:, held.cell[start]]) if start < end else []
                u, s = units[who], screen[who]
            if not len(who):
                continue
            for a in range(start, end, CHUNK_ROWS):
                i, j = self._pairs(u, s, held, a, min(end, a + CHUNK_ROWS))
                i = who[i]
                meant = (held.run[j] <= run[i]) & (node[i] != held.node[j])
                i, j = i[meant], j[meant]
                if not len(i):
                    continue
                np.add.at(links, i, held.copies[j])
                both = held.run[j] < run[i]
                np.add.at(self.links, held.first + j[both], copies[i[both]])
                j += held.first
                new = root[i] < 0
                root[i[new][::-1]] = j[new][::-1]
                apart = self.label[root[i]] != self.label[j]
                edges.append((root[i[apart]], j[apart]))
                waiting += int(apart.sum())
                if waiting > EDGES:
                    _unite(self.label, *map(np.concatenate, zip(*edges)))
                    edges, waiting = [], 0
        if waiting:
            _unite(self.label, *map(np.concatenate, zip(*edges)))
        return links, root


FOUND = "node bigint, links bigint, root bigint"


def _found(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)],
                                      ["node", "links", "root"])


def _verifier(threshold: float):
    """Links within a whole group of bounded size."""
    def judge(rows: pa.Table) -> pa.RecordBatch | None:
        n = rows.num_rows
        if n < 2:
            return None
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        x, none = _matrix(rows["vector"].combine_chunks()), np.zeros(n, np.int64)
        held = _held(0, node, copies, x, none, none, None, None)
        meeting = _Meeting(n, threshold)
        met = [meeting.meet(held, node[a:b], copies[a:b], x[a:b], none[a:b], none[a:b])
               for a, b in ((a, min(n, a + CHUNK_ROWS)) for a in range(0, n, CHUNK_ROWS))]
        links, root = map(np.concatenate, zip(*met))
        keep = np.flatnonzero(root >= 0)
        _unite(meeting.label, keep, root[keep])
        return _found(node[keep], links[keep], node[meeting.label[keep]])
    return judge


def _pivots(keyed: DataFrame, large: DataFrame, aim: int) -> dict[int, np.ndarray]:
    """Pivots of the large groups: some ``k / aim`` vectors with small hashes."""
    wanted = F.ceil(F.col("k") / aim)
    share = F.col("h2").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    rows = (keyed.join(F.broadcast(large), ["label", "dim"])
            .where(share * F.col("k") < 2 * wanted + 8)
            .groupBy("group", "h2", "h1").agg(F.first("vector").alias("vector"),
                                              F.first(wanted).alias("wanted")).toArrow())
    out: dict[int, list] = {}
    order = sorted(range(rows.num_rows), key=list(zip(
        *(rows[c].to_pylist() for c in ("group", "h2", "h1")))).__getitem__)
    for at in order:
        own = out.setdefault(rows["group"][at].as_py(), [])
        if len(own) < rows["wanted"][at].as_py():
            own.append(rows["vector"][at].as_py())
    return {g: _normal(np.array(v, np.float64)) for g, v in out.items()}


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch by the column ``group``, without its rows that have none."""
    for part in slices(batch, CHUNK_ROWS):
        group = part.column("group").fill_null(-1).to_numpy()
        for g in np.unique(group[group >= 0]).tolist():
            yield g, part.take(pa.array(np.flatnonzero(group == g)))


def _cell_sizes(keyed: DataFrame, large: DataFrame,
                pivots: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """Rows at home in each cell of the large groups."""
    known = keyed.sparkSession.sparkContext.broadcast(pivots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, part in _by_group(batch):
                p = known.value.get(g)
                cells = np.bincount(
                    np.zeros(part.num_rows, np.int64) if p is None else
                    _nearest(_normal(_matrix(part.column("vector"))), p),
                    minlength=1 if p is None else len(p))
                total[g] = total.get(g, 0) + cells
        for g, cells in total.items():
            n = len(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(cells.astype(np.int64))], ["group", "cell", "n"])

    given = keyed.join(F.broadcast(large), ["label", "dim"]).select("group", "vector")
    rows = (map_arrow(given, count, "group int, cell int, n bigint")
            .groupBy("group", "cell").agg(F.sum("n").alias("n")).collect())
    return {(r["group"], r["cell"]): r["n"] for r in rows}


def _placed(classes: DataFrame, pivots: dict[int, np.ndarray],
            sizes: dict[tuple[int, int], int], lengths: dict[int, int]) -> DataFrame:
    """``classes`` with their ``cell`` and ``slice``: a run of a large group in the
    order of its cells, numbered through all groups."""
    start: dict[int, np.ndarray] = {}
    room: dict[int, np.ndarray] = {}
    base: dict[int, int] = {}
    rows: dict[int, int] = {}
    last = 0
    for g, length in sorted(lengths.items()):
        n = np.array([sizes.get((g, c), 0) for c in range(len(pivots.get(g, [0])))], np.int64)
        room[g], start[g], base[g] = np.maximum(n, 1), np.cumsum(n) - n, last
        rows[g] = max(1, ROUND_BYTES // 4 // (8 * length))
        last += int(n.sum()) // rows[g] + 1
    known = classes.sparkSession.sparkContext.broadcast((pivots, start, room, base, rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, start, room, base, rows = known.value
        for batch in batches:
            for part in slices(batch, CHUNK_ROWS):
                n = part.num_rows
                cell, run = np.zeros(n, np.int32), np.full(n, -1, np.int32)
                group = part.column("group").fill_null(-1).to_numpy()
                for g in np.unique(group[group >= 0]).tolist():
                    own = np.flatnonzero(group == g)
                    if g in pivots:
                        x = _matrix(part.column("vector").take(pa.array(own)))
                        cell[own] = _nearest(_normal(x), pivots[g])
                    within = part.column("h1").to_numpy()[own].view(np.uint64) % room[g][
                        cell[own]].astype(np.uint64)
                    run[own] = base[g] + (start[g][cell[own]] + within.astype(np.int64)) // rows[g]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(run)],
                                                 [*part.schema.names, "cell", "slice"])

    schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("slice", T.IntegerType())])
    return map_arrow(classes, place, schema)


def _rounds(placed: DataFrame, lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """First and last slice to broadcast together, and the last one of their groups."""
    counts = sorted((r["slice"], r["group"], r["n"]) for r in placed.where("slice >= 0").groupBy(
        "slice", "group").agg(F.count("*").alias("n")).collect())
    ends = {g: s for s, g, _ in counts}
    out, held = [], 0
    for s, g, n in counts:
        size = n * lengths[g] * 8
        if out and held + size <= ROUND_BYTES:
            out[-1], held = (out[-1][0], s, ends[g]), held + size
        else:
            out.append((s, s, ends[g]))
            held = size
    return out


def _round(placed: DataFrame, bounds: tuple[int, int, int], pivots: dict[int, np.ndarray],
           axes: dict[int, np.ndarray | None], threshold: float) -> DataFrame:
    """Links between the vectors of some slices and of all not before them."""
    first, last, end = bounds
    rows = placed.where(F.col("slice").between(first, last)).select(
        "group", "cell", "slice", "node", "copies", "vector").toArrow().combine_chunks()
    groups = rows["group"].to_numpy()
    held, at = {}, 0
    for g in np.unique(groups).tolist():
        own = rows.take(pa.array(np.flatnonzero(groups == g)))
        x = _matrix(own["vector"].combine_chunks())
        if g not in axes:
            axes[g] = _axes(x, threshold)
        held[g] = _held(at, own["node"].to_numpy(), own["copies"].to_numpy(), x,
                        own["cell"].to_numpy(), own["slice"].to_numpy(), axes[g], pivots.get(g))
        at += len(x)
    del rows
    shared = placed.sparkSession.sparkContext.broadcast(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        names = np.concatenate([h.node for h in held.values()])
        meeting = _Meeting(len(names), threshold)
        for batch in batches:
            for g, part in _by_group(batch):
                node = part.column("node").to_numpy()
                links, root = meeting.meet(
                    held[g], node, part.column("copies").to_numpy(),
                    _matrix(part.column("vector")), part.column("cell").to_numpy(),
                    part.column("slice").to_numpy())
                keep = root >= 0
                if keep.any():
                    yield _found(node[keep], links[keep], names[root[keep]])
        keep = np.flatnonzero((meeting.links > 0) | (meeting.label != np.arange(len(names))))
        for a in range(0, len(keep), 1 << 16):
            some = keep[a:a + (1 << 16)]
            yield _found(names[some], meeting.links[some], names[meeting.label[some]])

    given = placed.where(F.col("slice").between(first, end)).select(
        "group", "cell", "slice", "node", "copies", "vector")
    out = shared_table(map_arrow(given, compare, FOUND))
    shared.destroy()
    return out


def _merged(tables: list[DataFrame]) -> DataFrame:
    """Results of several rounds as one table of fewer rows and files."""
    out = shared_table(reduce(DataFrame.unionByName, tables).groupBy("node", "root").agg(
        F.sum("links").alias("links")).select("node", "links", "root"))
    for table in tables:
        drop_table(table)
    return out


def range_join(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
               label: str = "label", threshold: float = THRESHOLD,
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vectors`` plus ``n_links``, ``component_id`` and ``kept``."""
    names = vectors.columns
    clash = {"n_links", "component_id", "kept"} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"the input already has the result columns {sorted(clash)}")
    id_col, vector_col, label_col = (f"c{names.index(c)}" for c in (key, vector, label))
    real = isinstance(vectors.schema[vector].dataType.elementType, (T.FloatType, T.DoubleType))
    # singles stay singles: they take half the room
    numbers = F.col(vector_col) if real else F.transform(vector_col, lambda x: x.cast("double"))
    infinite = F.lit(float("inf"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    usable = (F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
              & F.coalesce(finite, F.lit(False)) & F.exists(numbers, lambda x: x != 0))
    rows = vectors.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)]).withColumn(
        "vector", F.when(usable, numbers))
    rows = shared_table(rows.select(
        *[f"c{i}" for i in range(len(names))],
        *[F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(seed), "vector")).alias(h)
          for seed, h in ((1, "h1"), (2, "h2"))], F.monotonically_increasing_id().alias("row")))
    best = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("id"))
    keyed = rows.where("h1 is not null").select(
        F.col(label_col).alias("label"), F.size(vector_col).alias("dim"), "h1", "h2",
        numbers.alias("vector"), "row", best.alias("best"))
    sizes = shared_table(keyed.groupBy("label", "dim").agg(F.count("*").alias("k")))
    total = sizes.agg(F.sum("k")).first()[0] or 0
    aim = max(cell_rows, -(-total // MAX_PIVOTS))
    large = shared_table(sizes.where(F.col("k") > aim).coalesce(1).withColumn(
        "group", F.monotonically_increasing_id().cast("int")))
    lengths = {r["group"]: r["dim"] for r in large.select("group", "dim").collect()}
    classes = keyed.groupBy("label", "h1", "h2").agg(
        F.first("vector").alias("vector"), F.min("row").alias("node"),
        F.count("*").alias("copies"), F.min("best").alias("best")).withColumn("dim", F.size("vector"))
    classes = classes.join(F.broadcast(large.drop("k")), ["label", "dim"], "left")
    pivots = _pivots(keyed, large, aim) if lengths else {}
    cells = _cell_sizes(keyed, large, pivots) if lengths else {}
    placed = shared_table(_placed(classes, pivots, cells, lengths).sortWithinPartitions("slice"))
    own = ["label", "dim"]
    small = placed.where("slice < 0").select(
        *own, "node", "copies", "vector", *[F.lit(0).alias(c) for c in ("i", "j", "side")],
        F.xxhash64(*own).alias("block"))
    found = shared_table(per_block(small, own, ["node", "copies", "vector"], _verifier(threshold),
                                   FOUND))
    tables, axes = [found], {}
    for bounds in _rounds(placed, lengths):
        tables.append(_round(placed, bounds, pivots, axes, threshold))
        if len(tables) > MERGED:
            tables = [_merged(tables)]
    found = _merged(tables) if len(tables) > 1 else tables[0]
    result = placed.select("label", "h1", "h2", "node").join(
        grouped(placed, found), "node").drop("node")
    out = rows.withColumn("label", F.col(label_col)).join(result, ["label", "h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col(id_col)).otherwise(F.col("best.id"))
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept"))
