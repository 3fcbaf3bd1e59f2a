"""Token ids as length-limited canonical Huffman files.

``write_corpus`` tokenises documents in ascending ``doc_id``, counts every id of the corpus, derives one
code (package-merge, at most ``max_bits`` a code) and writes Parquet files of independent blocks: the
bit stream, the ids of each document, and the bit offset of every ``LANE`` ids. ``read_corpus`` decodes
the blocks with a table of ``2 ** max_bits`` entries; the bit offsets, of 64 bits, let all lanes of a block
advance side by side. Ids are counted in the pass that tokenises; a task adds one row with its counts. Neither keeps more than a batch of blocks in memory; a block is closed at
``block_ids`` ids and never splits a document.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` comes first; repeated rows are
written each; an empty table gives empty files; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folder
from .tokens import slices, tokenizer

LANE = 256
BLOCK_IDS = 65_536
RAW = "part int, block int, before long, doc_ids array<long>, n_ids array<long>, ids binary"
FILE = ("part int, block int, before long, doc_ids array<long>, n_ids array<long>, bits binary, "
        "checkpoints binary")


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Code length of each symbol (0 for a count of zero) by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need codes of over {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, from_symbol = weights, [np.ones(len(weights), bool)]
    for _ in range(max_bits - 1):
        even = len(merged) // 2 * 2
        both = np.concatenate([weights, merged[0:even:2] + merged[1:even:2]])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        from_symbol.append(rank < len(weights))
    need = 2 * len(weights) - 2
    for level in reversed(from_symbol):
        symbols = int(level[:need].sum())
        lengths[order[:symbols]] += 1
        need = 2 * (need - symbols)
    return lengths


@dataclass(frozen=True)
class Code:
    """A canonical code: lengths decide everything else."""

    lengths: np.ndarray
    max_bits: int

    def codes(self) -> np.ndarray:
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        sizes = self.lengths[order].astype(np.int64)
        room = np.int64(1) << (self.max_bits - sizes)
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[order] = ((np.cumsum(room) - room) >> (self.max_bits - sizes)).astype(np.uint64)
        return codes

    def decoding_table(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        room = 1 << (self.max_bits - self.lengths[order].astype(np.int64))
        symbols = np.zeros(1 << self.max_bits, np.uint32)
        symbols[:room.sum()] = np.repeat(order, room)
        return symbols, np.maximum(self.lengths[symbols], 1).astype(np.int64)


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of a block as big-endian 32-bit words, and the bit offset of every ``LANE`` ids."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    at = ends - sizes
    words = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 2, np.uint32)
    if len(ids):
        shifted = codes[ids] << (64 - sizes - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat((shifted >> np.uint64(32)).astype(np.uint32), first)
        rest = (shifted & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        over = np.flatnonzero(rest)
        words[word[over] + 1] |= rest[over]
    return words.astype(">u4").tobytes(), at[::LANE].astype("<i8").tobytes()


def decode_blocks(bits: list[bytes], checkpoints: list[bytes], sizes: list[int], table) -> list[np.ndarray]:
    """The ids of several blocks; every lane reads one id a step."""
    symbols, lengths = table
    max_bits = len(symbols).bit_length() - 1
    streams = [np.frombuffer(b, ">u4") for b in bits]
    starts = np.cumsum([0, *map(len, streams)])
    words = np.concatenate([*streams, np.zeros(2, ">u4")]).astype(np.uint64)
    lanes = [np.frombuffer(c, "<i8") for c in checkpoints]
    place = np.concatenate([lane + 32 * s for lane, s in zip(lanes, starts)] or [np.zeros(0, np.int64)])
    left = np.concatenate([np.minimum(LANE, n - LANE * np.arange(len(lane)))
                           for lane, n in zip(lanes, sizes)] or [np.zeros(0, np.int64)])
    out = np.zeros((len(place), LANE), np.uint32)
    top = 32 * len(words) - 64
    for step in range(int(left.max(initial=0))):
        word = place >> 5
        window = (words[word] << np.uint64(32)) | words[word + 1]
        entry = (window >> (64 - max_bits - (place & 31)).astype(np.uint64)) & np.uint64(len(symbols) - 1)
        out[:, step] = symbols[entry]
        place = np.minimum(place + lengths[entry], top)
    flat = out[np.arange(LANE) < left[:, None]]
    return np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []


COUNTS = -1                     # the number of the row that holds a task's counts in place of a block


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int) -> DataFrame:
    """Blocks of ids in ascending ``doc_id``; ``before`` counts the ids before it in its part.

    The last row of a part, numbered ``COUNTS``, holds how often each id stands in it, as 64-bit numbers.
    """
    names = [c.split()[0] for c in RAW.replace(" array<long>", "").split(", ")]

    def row(part, block, before, doc_ids, n_ids, data):
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
            pa.array([doc_ids], pa.list_(pa.int64())), pa.array([n_ids], pa.list_(pa.int64())),
            pa.array([data], pa.binary())], names=names)

    def tokenise(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        library, total = tokenizer(tokenizer_path), np.zeros(0, np.int64)
        doc_ids, n_ids, ids = (np.zeros(0, kind) for kind in (object, np.int64, np.uint32))     # the open block
        for batch in (s for b in batches for s in slices(b, "text")):
            flat, counts = library.encode(batch.column("text"))
            flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
            total = added(total, np.bincount(flat))
            ids = np.concatenate([ids, flat])
            n_ids = np.concatenate([n_ids, counts + 1])
            doc_ids = np.concatenate([doc_ids, np.array(batch.column("doc_id").to_pylist(), object)])
            ends, first, closed = np.cumsum(n_ids), 0, 0
            # a block is closed by the document that fills it
            while (last := int(np.searchsorted(ends, closed + block_ids))) < len(ends):
                stop = int(ends[last])
                yield row(part, block, before, doc_ids[first:last + 1].tolist(), n_ids[first:last + 1],
                          short(ids[closed:stop]))
                block, before, first, closed = block + 1, before + stop - closed, last + 1, stop
            doc_ids, n_ids, ids = doc_ids[first:], n_ids[first:], ids[closed:]
        if len(doc_ids):
            yield row(part, block, before, doc_ids.tolist(), n_ids, short(ids))
        yield row(part, COUNTS, 0, [], [], total.astype("<i8").tobytes())

    mixed = F.xxhash64("text")
    return (docs.select("doc_id", "text").repartitionByRange("doc_id", mixed)
            .sortWithinPartitions("doc_id", mixed).mapInArrow(tokenise, RAW))


def short(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers where all of them fit, else as 32-bit ones."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def ids_of(data, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def added(some: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The sum of two arrays that may differ in length."""
    long, short = (some, more) if len(some) > len(more) else (more, some)
    total = long.astype(np.int64)
    total[:len(short)] += short
    return total


def id_counts(raw: DataFrame) -> DataFrame:
    """How often each id stands in all parts; every task sends one count an id at most."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in batch.column("ids"):
                total = added(total, np.frombuffer(part.as_buffer(), "<i8"))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())],
                                         names=["id", "n"])

    parts = raw.where(F.col("block") == COUNTS).select("ids")
    return parts.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_corpus(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, max_bits: int = 16,
                 block_ids: int = BLOCK_IDS) -> None:
    """Write ``path``/blocks and ``path``/code. The driver holds one count for each id of the vocabulary."""
    spark = docs.sparkSession
    raw = folder(spark, "token-blocks")
    token_blocks(docs, tokenizer_path, end_id, block_ids).write.option("compression", "zstd").parquet(raw)
    written = spark.read.schema(RAW).parquet(raw)
    blocks = written.where(F.col("block") != COUNTS)
    found = id_counts(written).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    code = Code(code_lengths(counts, max_bits), max_bits)
    rows = [(int(k), int(code.lengths[k])) for k in np.flatnonzero(code.lengths)]
    spark.createDataFrame(rows, "id long, bits int").coalesce(1).write.parquet(f"{path}/code")

    def encode(batches):
        codes, lengths = code.codes(), code.lengths
        for batch in batches:
            done = [encode_block(ids_of(b.as_buffer(), sum(n)), codes, lengths)
                    for b, n in zip(batch.column("ids"), batch.column("n_ids").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array([d[0] for d in done], pa.binary()),
                 pa.array([d[1] for d in done], pa.binary())],
                names=["part", "block", "before", "doc_ids", "n_ids", "bits", "checkpoints"])

    blocks.mapInArrow(encode, FILE).write.option("compression", "none").parquet(f"{path}/blocks")


def read_corpus(spark: SparkSession, path: str, max_bits: int = 16, with_ids: bool = False) -> DataFrame:
    """One row per written document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    lengths = np.zeros(0, np.uint8)
    if found := spark.read.parquet(f"{path}/code").collect():          # one row an id of the vocabulary
        lengths = np.zeros(max(r.id for r in found) + 1, np.uint8)
        for r in found:
            lengths[r.id] = r.bits
    code = Code(lengths, max_bits)

    def decode(batches):
        table = code.decoding_table() if len(code.lengths) else None
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                yield documents(batch.slice(k, 16), table)

    def documents(batch, table):
        n_ids = batch.column("n_ids").to_pylist()
        blocks = decode_blocks(batch.column("bits").to_pylist(), batch.column("checkpoints").to_pylist(),
                               [sum(n) for n in n_ids], table)
        doc_ids, rows = batch.column("doc_ids").to_pylist(), []
        for k, (part, before) in enumerate(zip(batch.column("part").to_pylist(),
                                               batch.column("before").to_pylist())):
            stop, data = 0, blocks[k].astype("<u4").tobytes()
            for doc_id, n in zip(doc_ids[k], n_ids[k]):
                own = data[4 * stop:4 * (stop + n)]
                rows.append((part, doc_id, before + stop, n, zlib.crc32(own), own if with_ids else None))
                stop += n
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          names=["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.schema(FILE).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.expr(
        "aggregate(n_ids, 0L, (a, n) -> a + n)")).alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    docs = blocks.mapInArrow(decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(offsets, "part").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))
