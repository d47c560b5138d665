"""Language-model scores from a log-bilinear model trained with
noise-contrastive estimation.

Tokens are runs between ASCII white space with A-Z lower-cased, then one end.
The model predicts a token's class from the classes of the two tokens before
it: ``s(w) = q_w . (C1 r_v + C2 r_u) + b_w``.  A class is the end, one of the
most frequent words, or a group of all other words with the same ending; a word
of a group gets the group's probability times its smoothed share in it, so the
distribution covers every word.  Training runs in rounds over disjoint slices of
all training rows.  A round deals its rows by a hash of the row to groups, whose
number follows the training tokens; each group trains in numpy in the order of
that hash, and the parameters are averaged by tokens in the order of the groups.
Scores therefore do not depend on how the input is laid out in files.

As contexts are pairs of classes, batched matrix products give the normaliser of
every context, and tokens look up normalised log-probabilities.

Counts are taken over all training rows.  The most frequent words go to the
tasks (at most ``HOT_WORDS``, a checked bound); the counts of all others are
joined to the (row, word) pairs that need them.

Cases: a null or empty text is its end token only; texts of any length count
whole; repeated rows are counted and scored each; a null key is its own value
for the split; without training rows every token is unknown; an empty table
gives an empty result; further columns pass through and must not be named like
the results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import col, map_arrow, shared_table
from riskframe.llm.words import parts

#: Classes: the end, WORDS frequent words, ENDINGS groups of other words.
WORDS = 767
ENDINGS = 256
CLASSES = 1 + WORDS + ENDINGS
#: Frequent words whose counts go to the tasks (about 100 bytes each there).
HOT_WORDS = 131_072
DIMENSIONS = 32
ROUNDS = 3
BATCH = 1024
NOISE = 128
RATE = 0.1
SEED = 5
SMOOTH = 0.1
#: Distinct words a counting task holds before it passes them on.
FLUSH_WORDS = 200_000
#: Training tokens of a group, on average.
GROUP_TOKENS = 500_000
#: Parameter rows that one averaging task takes on.
FAN_IN = 64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; its end is left to the caller."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def ending(word: bytes) -> int:
    """Class of a word that is not among the frequent ones."""
    return 1 + WORDS + zlib.crc32(word[-3:]) % ENDINGS


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of all words of ``docs`` and the end (the empty word), written
    to the shared folder."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()),
                 pa.array(held.values(), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for part in parts(batch, 0):
                for t in part.column(0).to_pylist():
                    held.update(tokens_of(t))
                held[b""] += part.num_rows
                if len(held) > FLUSH_WORDS:
                    yield passed_on()
        yield passed_on()

    counted = map_arrow(docs.select(col(text)), count, "word string, c bigint")
    return shared_table(counted.groupBy("word").agg(F.sum("c").alias("c")))


@dataclass
class Lexicon:
    """What every task knows of the training words."""

    codes: dict[bytes, int]         # hot word -> place in the arrays
    kind: np.ndarray                # class of a hot word
    log_count: np.ndarray           # log10(c + SMOOTH) of a hot word
    log_mass: np.ndarray            # log10 of a group's smoothed count; 0 for other classes
    noise: np.ndarray               # share of every class among the training tokens
    total: int                      # N
    distinct: int                   # V


def lexicon(counts: DataFrame, hot_words: int = HOT_WORDS) -> tuple[Lexicon, DataFrame]:
    """The lexicon and the counts of the words it leaves out.

    Hot are the words above the smallest step of an eighth of a power of two
    that keeps them within ``hot_words``."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8)
    sizes = (counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum("c").alias("n"))
             .orderBy(F.desc("step")).collect())          # at most 8 rows a power of two
    total, distinct = sum(r["n"] for r in sizes), sum(r["k"] for r in sizes)
    held, least = 0, None
    for r in sizes:
        held += r["k"]
        if held > hot_words:
            break
        least = r["step"]
    known = least is not None
    got = counts.where(step >= least if known else F.lit(False)).toArrow()
    words, c = got["word"].to_pylist(), got["c"].to_numpy().astype(np.int64)
    rest = counts.where(step < least if known else F.lit(True))
    ranked = sorted(range(len(words)), key=lambda i: (-int(c[i]), words[i]))
    kind = np.array([ending(w.encode()) for w in words], dtype=np.int64)
    place = 1
    for i in ranked:
        if words[i] == "":
            kind[i] = 0
        elif place <= WORDS:
            kind[i] = place
            place += 1
    # sums of the groups over all other words
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            at = np.array([ending(w.encode()) if w else 0 for w in batch.column(0).to_pylist()],
                          dtype=np.int64)
            np.add.at(n, at, batch.column(1).to_numpy())
            k += np.bincount(at, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), pa.array(n), pa.array(k)], ["kind", "n", "k"])

    n, k = np.zeros(CLASSES, np.int64), np.bincount(kind, minlength=CLASSES)
    np.add.at(n, kind, c)
    for r in (map_arrow(rest, sums, "kind bigint, n bigint, k bigint").groupBy("kind")
              .agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()):
        n[r["kind"]] += r["n"]
        k[r["kind"]] += r["k"]
    mass = n + SMOOTH * (k + 1)                           # one unseen word in every group
    log_mass = np.where(np.arange(CLASSES) > WORDS, np.log10(mass), 0.0)
    noise = (n + 1) / (n + 1).sum()
    return Lexicon({w.encode(): i for i, w in enumerate(words)}, kind, np.log10(c + SMOOTH),
                   log_mass, noise, total, distinct), rest


def encoded(docs: DataFrame, lex: Lexicon, text: str) -> DataFrame:
    """``docs`` (columns c0..) with ``ids`` (classes, two bytes each),
    ``n_tokens``, sums over the hot words and the other words with their
    numbers; written with a row number."""
    names = [c for c in docs.columns if c != text]
    known = docs.sparkSession.sparkContext.broadcast(lex)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = known.value
        code = lex.codes.get
        for batch in batches:
            for part in parts(batch, len(names)):
                tokens, ends = [], []                     # of all texts, each with its end
                for t in part.column(len(names)).to_pylist():
                    tokens += tokens_of(t)
                    tokens.append(b"")
                    ends.append(len(tokens))
                starts = np.array([0, *ends[:-1]])
                at = np.fromiter(map(code, tokens, repeat(-1)), np.int64, len(tokens))
                there = at >= 0
                kinds, logs = np.zeros(len(at), dtype=np.int64), np.zeros(len(at))
                kinds[there] = lex.kind[at[there]]
                logs[there] = lex.log_count[at[there]]
                gone = np.flatnonzero(~there)
                unseen = [tokens[i] for i in gone.tolist()]   # the end itself may be unseen
                kinds[gone] = [ending(w) if w else 0 for w in unseen]
                # of the score: shares of hot words in their groups, masses of all groups
                shares = np.add.reduceat(np.where(kinds > WORDS, logs, 0.0) - lex.log_mass[kinds],
                                         starts)
                n = np.array(ends) - starts
                hot = np.add.reduceat(logs, starts)
                hot_known = np.add.reduceat(there, starts, dtype=np.int64)
                words, numbers, lost, last = [], [], [], 0
                for upto in np.searchsorted(gone, ends).tolist():
                    rare = Counter(unseen[last:upto])
                    words += [w.decode() for w in rare]
                    numbers += rare.values()
                    lost.append(len(rare))
                    last = upto
                ids = pa.Array.from_buffers(
                    pa.binary(), len(ends),
                    [None, pa.py_buffer(np.array([0, *ends], np.int32) * np.int32(2)),
                     pa.py_buffer(kinds.astype("<u2"))])
                structs = pa.StructArray.from_arrays(
                    [pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *lost]).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], ids,
                     pa.array(n, pa.int64()), pa.array(hot, pa.float64()),
                     pa.array(hot_known, pa.int64()), pa.array(shares, pa.float64()), lists],
                    [*names, "ids", "n_tokens", "hot", "hot_known", "shares", "rare"])

    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names] + [
        T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("hot", T.DoubleType()), T.StructField("hot_known", T.LongType()),
        T.StructField("shares", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StructType([
            T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])))])
    return shared_table(map_arrow(docs.select(*names, text), encode, schema)
                        .withColumn("row", F.monotonically_increasing_id()))


class Model:
    """Parameters: word vectors, two context matrices, target vectors, biases."""

    def __init__(self, lex_noise: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k, d = len(lex_noise), dimensions
        self.r = rng.normal(0, 0.3, (k, d)).astype(np.float32)
        self.q = rng.normal(0, 0.05, (k, d)).astype(np.float32)
        self.c = np.stack([np.eye(d), np.eye(d) * 0.5]).astype(np.float32)
        self.b = np.log(lex_noise).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at:at + p.size].reshape(p.shape)
            at += p.size


class Trainer:
    """Adagrad on the noise-contrastive loss; a batch shares its noise words."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int | list[int]):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.edges = np.cumsum(noise)
        self.past = [np.full(p.shape[:1] if p.ndim < 3 else p.shape, 1e-2, np.float32)
                     for p in model.parameters()]
        self.tokens = 0

    def step(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
        """One batch: targets ``w`` after ``v`` (next to them) and ``u``."""
        m, n = self.m, len(w)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(m.b) - 1)
        rv, ru = m.r[v], m.r[u]
        h = rv @ m.c[0] + ru @ m.c[1]
        qw, qn = m.q[w], m.q[drawn]
        yes = np.einsum("ij,ij->i", h, qw) + m.b[w] - self.log_noise[w]
        no = h @ qn.T + (m.b[drawn] - self.log_noise[drawn])
        gy = -1 / (1 + np.exp(np.clip(yes, -30, 30)))
        gn = 1 / (1 + np.exp(np.clip(-no, -30, 30)))
        dh = gy[:, None] * qw + gn @ qn
        read, dr = summed(np.concatenate([v, u]),
                          np.concatenate([dh @ m.c[0].T, dh @ m.c[1].T]))
        aimed, dq = summed(np.concatenate([w, drawn]),
                           np.concatenate([np.column_stack([gy[:, None] * h, gy]),
                                           np.column_stack([gn.T @ h, gn.sum(axis=0)])]))
        dc = np.stack([rv.T @ dh, ru.T @ dh])
        for p, past, at, g in zip(m.parameters(), self.past, (read, aimed, slice(None), aimed),
                                  (dr, dq[:, :-1], dc, dq[:, -1])):
            g = g / n
            square = (g * g).mean(axis=1) if p.ndim == 2 else g * g
            past[at] += square * n
            scale = np.sqrt(past[at] / n)
            p[at] -= RATE * g / (scale[:, None] if p.ndim == 2 else scale)
        self.tokens += n

    def texts(self, ids: list[bytes]) -> None:
        """Train on texts, in order, in whole batches."""
        w, v, u = contexts(ids)
        for at in range(0, len(w), BATCH):
            part = slice(at, at + BATCH)
            self.step(v[part], u[part], w[part])


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indexes of ``at``, ascending, and the sum of the ``rows`` of each."""
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return ranked[starts], np.add.reduceat(rows[order], starts, axis=0)


def contexts(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, of the token before each and of the one before
    that; before a text stand ends."""
    w = np.frombuffer(b"".join(ids), dtype="<u2").astype(np.int64)
    starts = np.cumsum([0, *(len(x) // 2 for x in ids)])[:-1]
    v = np.concatenate(([0], w[:-1]))
    v[starts] = 0
    u = np.concatenate(([0], v[:-1]))
    u[starts] = 0
    return w, v, u


def train(rows: DataFrame, noise: np.ndarray, tokens: int, rounds: int = ROUNDS) -> Model:
    """Train on ``rows`` (place, ids): all of them, a slice in every round.

    ``place`` is a hash of the row that decides its round, its group and its
    order there; ``tokens`` is the number of all tokens of ``rows``."""
    model = Model(noise)
    width = model.flat().size
    context = rows.sparkSession.sparkContext
    groups = max(1, -(-tokens // (rounds * GROUP_TOKENS)))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, place = 0, np.zeros(width), 0
        for batch in batches:
            for g, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                held += n * np.frombuffer(x, np.float32).astype(np.float64)
                total += n
                place = g // FAN_IN
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([total]),
                 pa.array([(held / total).astype(np.float32).tobytes()])], ["g", "n", "x"])

    for k in range(rounds):
        start = context.broadcast(model.flat())

        def learn(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            own = Model(noise)
            own.load(start.value)
            trainer, group = None, 0
            for batch in batches:
                ids = batch.column(1).to_pylist()
                if trainer is None:
                    group = batch.column(0)[0].as_py()
                    trainer = Trainer(own, noise, [SEED, k, group])
                for at in range(0, len(ids), 256):
                    trainer.texts(ids[at:at + 256])
            if trainer is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group], pa.int32()), pa.array([trainer.tokens]),
                     pa.array([own.flat().tobytes()])], ["g", "n", "x"])

        dealt = F.pmod(F.xxhash64(F.lit(k), "place"), F.lit(groups)).cast("int")
        mine = (rows.where(F.pmod(F.xxhash64(F.lit(-1), "place"), F.lit(rounds)) == k)
                .withColumn("g", dealt).repartitionById(groups, "g")       # a group is one task
                .sortWithinPartitions("place", "ids").select("g", "ids"))
        learnt, left = map_arrow(mine, learn, "g int, n bigint, x binary"), groups
        while True:
            left = -(-left // FAN_IN)
            learnt = map_arrow(
                learnt.repartitionById(left, (F.col("g") / FAN_IN).cast("int"))
                .sortWithinPartitions("g"), mean, "g int, n bigint, x binary")
            if left == 1:
                break
        for r in learnt.collect():                        # one row
            model.load(np.frombuffer(bytes(r["x"]), np.float32))
    return model


def normalisers(spark, model: Model) -> np.ndarray:
    """log Z of every context (v, u): batched matrix products over v."""
    known = spark.sparkContext.broadcast(model.flat())
    k = len(model.b)
    noise = np.full(k, 1 / k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(noise)
        own.load(known.value)
        far = own.r @ own.c[1] @ own.q.T                  # u by w
        for batch in batches:
            for v in batch.column(0).to_pylist():
                s = far + (own.r[v] @ own.c[0] @ own.q.T + own.b)
                top = s.max(axis=1)
                z = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v]), pa.array([z.astype(np.float32).tobytes()])], ["v", "z"])

    out = np.empty((k, k), dtype=np.float32)
    for r in map_arrow(spark.range(k), products, "v bigint, z binary").collect():
        out[r["v"]] = np.frombuffer(bytes(r["z"]), np.float32)
    return out


def score(docs: DataFrame, train_on: Column, text: str = "text", rounds: int = ROUNDS,
          hot_words: int = HOT_WORDS) -> DataFrame:
    """``docs`` without ``text``, plus ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (smoothed unigram) and ``score`` (model),
    both log10 probabilities of the whole text.  ``train_on`` is a condition on
    the columns of ``docs``."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != text]
    clash = {"n_tokens", "n_known", "train_tokens", "base_score", "score"} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"the input already has the result columns {sorted(clash)}")
    given = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)],
                        F.coalesce(train_on, F.lit(False)).alias("learns"),
                        col(text).alias("the_text"))
    counts = count_words(given.where("learns"), "the_text")
    lex, rest = lexicon(counts, hot_words)
    coded = encoded(given, lex, "the_text")
    # equal rows are interchangeable; maps have no hash
    keys = [c for c in coded.columns if c.startswith("c") and c[1:].isdigit()
            and "map<" not in coded.schema[c].dataType.simpleString()]
    model = train(coded.where("learns").select(F.xxhash64(*keys, "ids").alias("place"), "ids"),
                  lex.noise, lex.total, rounds)
    near = model.r @ model.c[0] @ model.q.T + model.b
    far = model.r @ model.c[1] @ model.q.T
    tables = spark.sparkContext.broadcast((near, far, normalisers(spark, model)))
    keep = [c for c in coded.columns if c not in ("ids", "rare")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, z = tables.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(len(keep)).to_pylist()
                w, v, u = contexts(ids)
                logs = (near[v, w] + far[u, w] - z[v, u]).astype(np.float64)
                ends = np.cumsum([0, *(len(x) // 2 for x in ids)])
                sums = np.add.reduceat(logs, ends[:-1]) / np.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(sums)],
                                                 [*keep, "model"])

    schema = T.StructType([coded.schema[c] for c in keep] + [T.StructField("model", T.DoubleType())])
    scored = map_arrow(coded.select(*keep, "ids"), look_up, schema)
    asked = coded.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    lost = (asked.join(rest, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * log_count).alias("lost"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("lost_known"),
        F.sum(F.when(F.col("word") == "", F.col("n") * log_count)).alias("lost_end")))
    zero = F.lit(0.0)
    seen = F.coalesce("lost", zero)
    base = F.col("hot") + seen - F.col("n_tokens") * float(
        np.log10(lex.total + SMOOTH * (lex.distinct + 1)))
    # an unseen end is a class of its own and has no share in a group
    shares = F.col("shares") + seen - F.coalesce("lost_end", zero)
    return scored.join(lost, "row", "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_tokens",
        (F.col("hot_known") + F.coalesce("lost_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(lex.total)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("model") + shares).alias("score"))
