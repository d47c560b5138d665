"""Training-order materialisation of token sequences as fixed-stride shards.

Texts become token ids (two bytes each, a document end after every text).  The
ids of an input partition are packed end to end into sequences of ``SEQUENCE``
ids; the partition's last one is padded with document ends.  Sequences are
numbered 0..N-1 and a keyed Feistel permutation with cycle-walking sends every
number to a global slot, so the training order is random, reproducible and
invertible without a shuffle table.  Slot ``s`` lies in shard
``s // shard_slots`` at byte ``(s % shard_slots) * stride``: a reader resumes
at any slot with one seek.

Tokens are made twice, once to count the sequences of every input partition
and once to write them, instead of being stored in between.  Both passes number
rows by input partition, so the input has to be read, not computed: files, or a
written table.  A second pass that meets other rows fails.

A shard is written under a name of its own attempt and renamed when complete,
so repeated or lost tasks leave whole shards only.

Cases: a null or empty text has its document end only; texts of any length are
packed whole; repeated rows are packed again; an empty table makes no shard;
only the text and key columns are read, others may have any name.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.bytebpe import WHITE_SPACE, default_pattern, encode_text, load_encoding
from riskframe.llm.common import col, map_arrow
from riskframe.llm.words import parts
from riskframe.session import ensure_checkpoint_dir

SEQUENCE = 512
SHARD_SLOTS = 8192
KEY = 0x5EED_0F_0DE5
ROUNDS = 4
DOCUMENT_END = 50256


def default_vocabulary() -> str:
    """File of the public byte-level BPE ranks of this machine."""
    from public_tokenizers import path
    return path("byte_bpe_50k.tiktoken")


#: End of the pattern: white space before a word keeps its last character for it.
#: The look-ahead takes the matcher's slow way; between words that one white space
#: character parts, its two rules match what ``\s+`` does.
BLANK_RULES, BLANK_RULE = r"|\s+(?!\S)|\s+", r"|\s+"
_BLANKS = re.compile(f"[{''.join(map(chr, WHITE_SPACE))}]{{2}}")
_BLANK_BYTES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def blanks_in_a_row(text: str) -> bool:
    """Whether two white space characters of the text are neighbours."""
    if text.isascii():
        return b"  " in text.encode().translate(_BLANK_BYTES)
    return _BLANKS.search(text) is not None


class Coder:
    """Byte BPE ids of whole texts."""

    def __init__(self, vocabulary: str):
        pattern = default_pattern()
        self.plain = self.quick = load_encoding(vocabulary, pattern)
        if pattern.endswith(BLANK_RULES):
            self.quick = load_encoding(vocabulary, pattern.removesuffix(BLANK_RULES) + BLANK_RULE)

    def coded(self, text: str) -> list[int]:
        return encode_text(self.plain if blanks_in_a_row(text) else self.quick, text)

    def count(self, text: str) -> int:
        return len(self.coded(text))

    def ids(self, text: str) -> bytes:
        """Little-endian ids of a whole text."""
        return array("H", self.coded(text)).tobytes()


@functools.lru_cache(maxsize=1)
def loaded(vocabulary: str) -> Coder:
    """The coder, read once by a worker and kept for its next tasks."""
    return Coder(vocabulary)


def feistel(numbers: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS,
            inverse: bool = False) -> np.ndarray:
    """Slots of ``numbers`` (int64 in [0, total)): a balanced Feistel network
    over the next even number of bits, walked until the result is below
    ``total``.  A bijection of [0, total); ``inverse`` undoes it."""
    half = np.uint64((max(2, (total - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    order = range(rounds - 1, -1, -1) if inverse else range(rounds)

    def mixed(x: np.ndarray, k: int) -> np.ndarray:
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in order:
            if inverse:
                left, right = right ^ mixed(left, k), left
            else:
                left, right = right, left ^ mixed(right, k)
        return left << half | right

    out = once(numbers.astype(np.uint64))
    while (over := out >= total).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Where the slots of a written set are."""

    path: str
    total: int
    sequence: int
    shard_slots: int

    @property
    def stride(self) -> int:
        return 2 * self.sequence


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") \
        else (fs.LocalFileSystem(), path)


def shard_file(path: str, shard: int) -> str:
    return f"{path.rstrip('/')}/shard-{shard:08d}.bin"


def read_slots(layout: Layout, start: int, count: int) -> Iterator[np.ndarray]:
    """Sequences of the slots from ``start`` on, read in order."""
    end = min(layout.total, start + count)
    while start < end:
        shard, at = divmod(start, layout.shard_slots)
        n = min(layout.shard_slots - at, end - start)
        store, path = _store(shard_file(layout.path, shard))
        with store.open_input_file(path) as f:
            f.seek(at * layout.stride)
            block = np.frombuffer(f.read(n * layout.stride), dtype="<u2")
        yield from block.reshape(n, layout.sequence)
        start += n


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, sequence: int
            ) -> Iterator[tuple[object, bytes, int]]:
    """Sequences of one input partition: key of the row that a sequence starts
    in, its bytes, its ids without padding."""
    coder, end = loaded(vocabulary), DOCUMENT_END.to_bytes(2, "little")
    stride, left, left_key = 2 * sequence, b"", None
    for batch in batches:
        for part in parts(batch, 1):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                whole = left + coder.ids(text or "") + end
                if not left:
                    left_key = key
                cut = len(whole) // stride * stride
                for at in range(0, cut, stride):
                    yield (left_key if at == 0 else key), whole[at:at + stride], sequence
                if cut:
                    left_key = key
                left = whole[cut:]
    if left:
        yield left_key, left + end * ((stride - len(left)) // 2), len(left) // 2


def write_shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 vocabulary: str | None = None, path: str | None = None,
                 sequence: int = SEQUENCE, shard_slots: int = SHARD_SLOTS,
                 seed: int = KEY) -> tuple[DataFrame, Layout]:
    """The manifest and the layout: reading the manifest writes the shards.

    The manifest has a row per sequence: ``slot``, ``shard``, ``at`` (byte in
    the shard), ``first_key`` (row that the sequence starts in), ``n_ids``
    (without padding) and ``crc`` of its bytes."""
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    given = docs.select(col(key).cast("string").alias("key"), col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ids = loaded(vocabulary), 0
        for batch in batches:
            for some in parts(batch, 1):
                ids += sum(coder.count(t or "") + 1 for t in some.column(1).to_pylist())
        n = -(-ids // sequence)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          "n": pa.array([n], pa.int64())})

    counts = {r["part"]: r["n"] for r in map_arrow(given, count, "part int, n bigint").collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    known = spark.sparkContext.broadcast((starts, counts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        start, expected = known.value[0].get(part, 0), known.value[1].get(part, 0)
        squeeze = zstandard.ZstdCompressor(level=1)
        keys, blocks, sizes, done = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            slots = feistel(np.arange(start + done, start + done + len(keys), dtype=np.int64),
                            total, seed)
            return pa.RecordBatch.from_arrays(
                [pa.array((slots // shard_slots).astype(np.int32)), pa.array(slots),
                 pa.array(keys, pa.string()), pa.array(sizes, pa.int32()),
                 pa.array(blocks, pa.binary())], ["shard", "slot", "first_key", "n_ids", "block"])

        for k, block, n in _packed(batches, vocabulary, sequence):
            if done + len(keys) >= expected:
                raise ValueError("the input changed between the two passes")
            keys.append(k)
            blocks.append(squeeze.compress(block))
            sizes.append(n)
            if len(keys) == 4096:
                yield flushed()
                done += len(keys)
                keys, blocks, sizes = [], [], []
        if keys:
            yield flushed()
        if done + len(keys) != expected:
            raise ValueError("the input changed between the two passes")

    n_shards = -(-total // shard_slots)
    dealt = map_arrow(given, deal, "shard int, slot bigint, first_key string, n_ids int, block binary")
    tasks = max(1, min(n_shards, 20_000))
    ranged = dealt.repartitionById(tasks, (F.col("shard") % tasks).cast("int")) \
        .sortWithinPartitions("shard", "slot")
    layout = Layout(path, total, sequence, shard_slots)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        shard, held = None, []

        def put() -> None:
            store, name = _store(shard_file(path, shard))
            store.create_dir(name.rpartition("/")[0], recursive=True)
            own = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(b"".join(held))
            store.move(own, name)

        for batch in batches:
            crcs = []
            for s, block in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                raw = expand.decompress(block, max_output_size=layout.stride)
                crcs.append(zlib.crc32(raw))
                if s != shard:
                    if held:
                        put()
                    shard, held = s, []
                held.append(raw)
            slots = batch.column(1)
            at = slots.to_numpy() % shard_slots * layout.stride
            yield pa.RecordBatch.from_arrays(
                [slots, batch.column(0), pa.array(at), batch.column(2), batch.column(3),
                 pa.array(crcs, pa.int64())], ["slot", "shard", "at", "first_key", "n_ids", "crc"])
        if held:
            put()

    manifest = map_arrow(ranged, write, "slot bigint, shard int, at bigint, first_key string, "
                                        "n_ids int, crc bigint")
    return manifest, layout
