"""BPE encoding and decoding through a table of distinct words.

Words are split off at ASCII white space; trailing punctuation after an ASCII
letter is a word of its own and A-Z are lower-cased, which a tokenizer whose
own rules split and lower-case there does not see.  Spark counts the distinct
words, the tokenizer library encodes each of them once, and a text gets its ids
back by position.  Decoding goes through an id-to-piece join.

The word table returns to the texts in two ways.  Its most frequent words are
broadcast in a packed form of at most ``HOT_BYTES``, whose size is checked
first; the others are joined back to the texts that hold them.  While the
whole table fits, nothing is left for the join.

Cases: a null or empty text has no ids and decodes to the empty text; texts of
any length are encoded whole; equal texts get equal ids; an empty table gives
an empty result; further columns pass through, and one named like a result is
replaced by it.
"""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import col, fresh_name, map_arrow, shared_table, slices
from riskframe.llm.words import parts, split_words

#: Bytes of packed words that may be broadcast.
HOT_BYTES = 160_000_000
#: Bytes of packed words that reach the driver at once.
SLICE_BYTES = 24_000_000
#: Distinct words a counting task holds before it passes them on.
FLUSH_WORDS = 60_000
#: Distinct chunks with their ids that a task keeps at hand (some 200 bytes each).
KEPT_WORDS = 400_000
#: Texts decoded together.
ROWS = 128

_TAIL = b".,!?;:|&"


def default_vocabulary() -> str:
    """File of the public lower-casing word BPE vocabulary of this machine."""
    from public_tokenizers import path
    return path("word_bpe_49k.json")


def load_tokenizer(vocabulary: str):
    """The library's tokenizer without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    out = Tokenizer.from_file(vocabulary)
    out.no_truncation()
    out.no_padding()
    return out


def parts_of(chunk: bytes) -> tuple[bytes, ...]:
    """A chunk as one or two words: its lower-cased body, punctuation after an
    ASCII letter."""
    if b"<" in chunk:                     # may hold an added token, found as it is spelt
        return (chunk,)
    low = chunk.lower()                   # of bytes: A-Z alone
    if low[-1:] not in _TAIL:
        return (low,)
    body = low.rstrip(_TAIL)
    if len(body) < len(low) and body[-1:].isalpha():
        return body, low[len(body):]
    return (low,)


def word_table(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(word, n, h, ids, packed) of all distinct words, written to the shared
    folder.  ``n`` counts occurrences, ``h`` is the word's hash, ``ids`` its token
    ids, ``packed`` the same in as few bytes as an id needs."""
    vocabulary = vocabulary or default_vocabulary()
    kind = id_type(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words: Counter[bytes] = Counter()
            for chunk, n in chunks.items():
                for word in parts_of(chunk):
                    words[word] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words.keys(), pa.binary()).cast(pa.string()),
                 pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in parts(batch, 0):
                for t in part.column(0).to_pylist():
                    chunks.update(split_words(t))
                if len(chunks) > FLUSH_WORDS:
                    yield passed_on()
        yield passed_on()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch, 4096):
                words = part.column(0).to_pylist()
                coded = tokenizer.encode_batch(words, add_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(hashes(words).view(np.int64)),
                     pa.array([x.ids for x in coded], pa.list_(pa.int32())),
                     pa.array([np.array(x.ids, kind).tobytes() for x in coded], pa.binary())],
                    ["word", "n", "h", "ids", "packed"])

    counted = (map_arrow(docs.select(col(text)).where(col(text).isNotNull()), count,
                         "word string, n bigint")
               .groupBy("word").agg(F.sum("n").alias("n")))
    return shared_table(map_arrow(counted, encode, "word string, n bigint, h bigint, ids array<int>, "
                                           "packed binary"))


def hashes(words: list[str] | list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64,
                       count=len(words))


class Packed:
    """Words as sorted 64-bit hashes with their ids end to end."""

    def __init__(self, tables: Iterable[pa.Table], kind: str):
        """``tables``: ``h`` and ``packed`` of the words, each table beyond the
        hashes of the one before; ``kind``: type of an id."""
        own, sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)]
        for table in tables:
            if not table.num_rows:
                continue
            h = table["h"].to_numpy()
            order = np.argsort(h)
            own.append(h[order])
            taken = pa.concat_arrays(table["packed"].chunks).take(pa.array(order))
            sizes.append(pc.binary_length(taken).to_numpy() // np.dtype(kind).itemsize)
            n = int(sizes[-1].sum())
            if n:
                ids.append(np.frombuffer(taken.buffers()[2], kind, n))
        self.hashes = np.concatenate(own)
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words share a hash")
        self.ends = np.cumsum(np.concatenate(sizes)).astype(np.uint32)
        self.ids = np.concatenate(ids)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the words' ids in ``ids``; -1 ids: not here."""
        wanted = hashes(words).view(np.int64)
        if not len(self.hashes):
            return np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        starts = np.where(at > 0, self.ends[at - 1], 0).astype(np.int64)
        return starts, np.where(self.hashes[at] == wanted, self.ends[at] - starts, -1)


class Known:
    """Chunks that a task has met, by number in the order of their first use, with
    their ids end to end: a text asks for each of its chunks once."""

    def __init__(self, hot: Packed, kind: str):
        self.hot, self.kind = hot, kind
        self.forget()

    def forget(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, self.kind)

    def ids_of(self, texts: list[list[bytes]], joined: Callable[[], dict[bytes, np.ndarray]]
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts' chunks end to end, and the places in between texts;
        ``joined`` gives the ids of words that are not among the packed ones."""
        if len(self.numbers) > KEPT_WORDS:
            self.forget()
        known, sizes = len(self.numbers), np.fromiter(map(len, texts), np.int64, len(texts))
        asked = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64,
                            int(sizes.sum()))
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)), joined)
        starts = self.ends[asked]
        lengths = self.ends[asked + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return (gathered(self.ids, starts, lengths),
                ends[np.concatenate([[0], np.cumsum(sizes)])])

    def _learn(self, chunks: list[bytes], joined: Callable[[], dict[bytes, np.ndarray]]) -> None:
        split = [parts_of(c) for c in chunks]
        words = [w for p in split for w in p]
        starts, sizes = self.hot.look_up(words)
        lost = np.flatnonzero(sizes < 0).tolist()
        if lost:
            more = joined()
            sizes[lost] = [len(more[words[i]]) for i in lost]
        flat, ends = gathered(self.hot.ids, starts, sizes), np.cumsum(sizes)
        for i in lost:
            flat[ends[i] - sizes[i]:ends[i]] = more[words[i]]
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split))) - 1
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[last]])
        self.ids = np.concatenate([self.ids, flat])


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` that begin at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
    return ids.take(at, mode="clip") if len(ids) else np.zeros(len(at), ids.dtype)


def spelt(pieces: pa.Array, ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Texts of the pieces of ``ids`` cut at ``ends``; a piece has a space before
    it, which the first of a text loses."""
    spelled = pieces.take(ids)
    places = np.frombuffer(spelled.buffers()[1], np.int64, len(ids) + 1, spelled.offset * 8)[ends]
    raw = memoryview(spelled.buffers()[2] or b"")
    return pa.array([bytes(raw[a + 1:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())],
                    pa.binary()).cast(pa.string())


def id_type(vocabulary: str) -> str:
    """Smallest type that holds every id of the vocabulary."""
    return "<u2" if load_tokenizer(vocabulary).get_vocab_size() <= 65536 else "<i4"


def hash_slices(words: DataFrame, cost: int) -> Iterator[pa.Table]:
    """``words`` in ascending ranges of ``h``, one after the other, so that the
    driver holds ``SLICE_BYTES`` or so of them besides what it has packed."""
    bits = max(0, (cost // SLICE_BYTES).bit_length())
    if not bits:
        yield words.toArrow()
        return
    for k in range(-2 ** (bits - 1), 2 ** (bits - 1)):
        yield words.where(F.shiftright("h", 64 - bits) == k).toArrow()


def split_hot(table: DataFrame, kind: str, hot_bytes: int = HOT_BYTES
              ) -> tuple[Packed, DataFrame | None]:
    """The packed frequent words and the rest of the table (null: none is left).

    A word costs 16 bytes and 4 per id.  If all words together cost more than
    ``hot_bytes``, the words that occur at least ``n`` times are kept, for the
    smallest power of two that fits."""
    cost = F.lit(16) + 4 * F.size("ids")
    power = F.floor(F.log2(F.col("n").cast("double")))
    sizes = (table.groupBy(power.alias("power")).agg(F.sum(cost).alias("cost"))
             .orderBy(F.desc("power")).collect())          # at most 64 rows
    total, least = 0, None
    for r in sizes:
        total += r["cost"]
        if total > hot_bytes:
            break
        least = r["power"]
    if least is None:
        hot, rest = table.limit(0), table if sizes else None
    else:
        hot = table.where(power >= least)
        rest = table.where(power < least) if total > hot_bytes else None
    packed = Packed(hash_slices(hot.select("h", "packed"), min(total, hot_bytes)), kind)
    return packed, None if rest is None else rest.select("word", "ids")


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None,
           hot_bytes: int = HOT_BYTES, decoded: str | None = None,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the token ids of ``text`` (array of int); with ``decoded``
    also the text that the ids decode to, in the same pass: the pieces of each
    distinct word's ids are looked up once.  ``keep`` names the columns that pass
    through, by default all; one named like a result is replaced by it."""
    vocabulary = vocabulary or default_vocabulary()
    kind = id_type(vocabulary)
    packed, rest = split_hot(word_table(docs, text, vocabulary), kind, hot_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(
        (packed, pa.array([f" {p}".encode() for p in pieces(vocabulary)], pa.large_binary())
         if decoded is not None else None))
    new = {n.lower() for n in (ids, decoded) if n is not None}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    place = names.index(text) if text in names else len(names)
    own, more, key = (fresh_name(docs, n) for n in ("the_text", "more", "text_key"))
    given = docs.withColumn(own, col(text))
    if rest is not None:
        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot = shared.value[0]
            for batch in batches:
                for part in parts(batch, 1):
                    keys, words = [], []
                    for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        own = list({w for c in set(split_words(t)) for w in parts_of(c)})
                        missing = np.nonzero(hot.look_up(own)[1] < 0)[0].tolist()
                        keys += [k] * len(missing)
                        words += [own[i] for i in missing]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.string()),
                         pa.array(words, pa.binary()).cast(pa.string())], ["k", "word"])

        given = given.withColumn(key, F.sha2(col(text), 256))
        asked = map_arrow(given.where(col(own).isNotNull()).select(key, own), rare,
                          "k string, word string").distinct()
        found = (asked.join(rest, "word").groupBy("k")
                 .agg(F.collect_list(F.struct("word", "ids")).alias(more))
                 .withColumnRenamed("k", key))
        given = given.join(found, key, "left").drop(key)
    else:
        given = given.withColumn(more, F.lit(None).cast("array<struct<word:string,ids:array<int>>>"))
    at_more = max(place + 1, len(names))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, piece = shared.value
        kept = Known(hot, kind)
        for batch in batches:
            for part in parts(batch, place):
                texts = [split_words(t) for t in part.column(place).to_pylist()]
                flat, ends = kept.ids_of(texts, lambda: {
                    x["word"].encode(): np.array(x["ids"], dtype=kind)
                    for extra in part.column(at_more).to_pylist() for x in extra or ()})
                flat = pa.array(flat.astype(np.int32))
                made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)]
                if piece is not None:
                    made.append(spelt(piece, flat, ends))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], *made], schema.names)

    types = [docs.schema[c].dataType for c in names] + [T.ArrayType(T.IntegerType())]
    types += [T.StringType()] if decoded is not None else []
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    renamed = given.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)],
                           *([col(own).alias("own")] if place == len(names) else []),
                           col(more).alias("more"))
    return map_arrow(renamed, positions, schema).toDF(
        *names, ids, *([decoded] if decoded is not None else []))


def pieces(vocabulary: str | None = None) -> list[str]:
    """Piece of every id: the fixed vocabulary, whatever the corpus."""
    tokenizer = load_tokenizer(vocabulary or default_vocabulary())
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]


def decode(coded: DataFrame, ids: str = "ids", decoded: str = "decoded",
           vocabulary: str | None = None) -> DataFrame:
    """``coded`` without ``ids``, plus the decoded text: the pieces of the ids,
    joined to them by position, with a space between.  The piece table is the
    vocabulary (some 50,000 rows) and goes along with the tasks."""
    table = coded.sparkSession.sparkContext.broadcast(pieces(vocabulary))
    names = [c for c in coded.columns if c != ids]

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = table.value
        for batch in batches:
            for part in slices(batch, ROWS):
                lists = part.column(len(names))
                flat = lists.flatten().to_numpy()
                texts, at = [], 0
                for n in lists.value_lengths().to_pylist():
                    texts.append(" ".join([piece[i] for i in flat[at:at + (n or 0)].tolist()]))
                    at += n or 0
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], pa.array(texts, pa.string())],
                    [f"c{i}" for i in range(len(names) + 1)])

    types = [coded.schema[c].dataType for c in names] + [T.StringType()]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    given = coded.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)],
                         col(ids).alias("ids"))
    return map_arrow(given, join_back, schema).toDF(*names, decoded)
