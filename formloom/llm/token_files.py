"""Token ids in files of fixed-width packed bits.

A file is: 8 bytes magic, then little-endian int64 bits, block_ids, n_docs, n_ids; the documents' ids (int64), lengths
(int64) and null marks (one byte each); the byte offset of every block (int64); the blocks. A block holds block_ids
ids (the last one fewer) of `bits` bits each, most significant bit first, so any id is found at block offset + bits *
index: id_at() reads the head, one offset and at most 5 bytes of a stored file.

Documents are dealt by ranges of doc_id, whose bounds come from a pass over doc_id alone; a range's files follow each
other. Files are written by the tasks into the shared folder, each attempt under names of its own, and only the names
of committed attempts get into the manifest (range_no, file_no, local_start, n_ids, path) that readers follow, so a lost
executor or a retried task leaves at most files that nobody reads.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, lean, materialise, shared_dir, shuffle_width, table
from .tokenise import encoder

MAGIC = b"FLBITS02"
_HEAD = 40


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each (1 to 32), padded to whole bytes at the end. Eight ids fill `bits` bytes."""
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint8)
    for k in range(8):
        first, end = k * bits, (k + 1) * bits
        for byte in range(first // 8, (end + 7) // 8):
            shift = end - 8 * (byte + 1)
            out[:, byte] |= ((rows[:, k] >> np.uint64(shift) if shift >= 0 else rows[:, k] << np.uint64(-shift)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: (len(ids) * bits + 7) // 8]


def unpack_bits(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first n ids of pack_bits() output, as uint32."""
    flat = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
    flat[:-8] = np.frombuffer(data, np.uint8, len(flat) - 8)
    at = np.arange(n, dtype=np.int64) * bits
    wide = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))[at >> 3].astype(np.uint64)
    return ((wide >> (64 - bits - (at & 7)).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def image(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block_ids: int = 65_536) -> list[bytes]:
    """The parts of one file, to be written one after the other."""
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack_bits(flat[a : a + block_ids], bits) for a in range(0, len(flat), block_ids)]
    head = MAGIC + np.array([bits, block_ids, len(docs), len(flat)], "<i8").tobytes()
    head += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(d) for d in docs], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    sizes = np.array([0, *map(len, blocks)], np.int64)
    return [head + (len(head) + 8 * len(blocks) + np.cumsum(sizes)[:-1]).astype("<i8").tobytes(), *blocks]


def opened(path: str):
    """A seekable reader of a file in any store that Arrow knows by its address."""
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _head(f) -> tuple[int, int, int, int]:
    head = f.read_at(_HEAD, 0)
    if head[:8] != MAGIC:
        raise ValueError("not a bit-packed id file")
    return tuple(np.frombuffer(head, "<i8", 4, 8).tolist())


def documents_of(f, most: int = 4_000_000):
    """Of an opened file, chunk by chunk of at least `most` ids: (document ids, their lengths, their ids, joined)."""
    bits, block_ids, n_docs, n_ids = _head(f)
    docs, lens = (np.frombuffer(f.read_at(8 * n_docs, _HEAD + 8 * n_docs * k), "<i8") for k in (0, 1))
    null = np.frombuffer(f.read_at(n_docs, _HEAD + 16 * n_docs), np.uint8)
    blocks = np.frombuffer(f.read_at(8 * -(-n_ids // block_ids), _HEAD + 17 * n_docs), "<i8").tolist()
    names = [None if x else d for d, x in zip(docs.tolist(), null.tolist())]
    ends = np.cumsum(lens)
    held, have, block, doc = [], 0, 0, 0
    while doc < n_docs:
        base = int(ends[doc - 1]) if doc else 0
        while block < len(blocks) and have < most:
            n = min(block_ids, n_ids - block * block_ids)
            held.append(unpack_bits(f.read_at((n * bits + 7) // 8, blocks[block]), n, bits))
            have, block = have + n, block + 1
        stop = n_docs if block == len(blocks) else int(np.searchsorted(ends, base + have, "right"))
        flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
        used = (int(ends[stop - 1]) if stop else 0) - base
        if stop > doc:
            yield names[doc:stop], lens[doc:stop], flat[:used]
        else:
            most += block_ids  # one document is longer than that
        held, have, doc = [flat[used:]], have - used, stop


def id_at(path: str, index: int) -> int:
    """One id of a stored file by random access."""
    with opened(path) as f:
        bits, block_ids, n_docs, n_ids = _head(f)
        if not 0 <= index < n_ids:
            raise IndexError(index)
        block, k = divmod(index, block_ids)
        at = int.from_bytes(f.read_at(8, _HEAD + 17 * n_docs + 8 * block), "little")
        first, end = bits * k, bits * (k + 1)
        raw = int.from_bytes(f.read_at((end + 7) // 8 - first // 8, at + first // 8), "big")
        return raw >> (-end % 8) & ((1 << bits) - 1)


def range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most value, by binary search; null counts 0."""
    steps = len(bounds).bit_length()
    if not steps:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 64 else F.from_json(F.lit(str(bounds)), "array<long>")
    halves = F.array(*[F.lit(1 << j) for j in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(table, at + half - 1) <= value, half).otherwise(F.lit(0)))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, file_ids: int = 4_000_000) -> DataFrame:
    """Encode docs(doc_id, text) and write files in ascending doc_id order; returns the manifest.

    Special tokens' strings in a text are ordinary text (see tokenise). Null text is an empty text, so its end id only;
    a null doc_id sorts first; rows of equal doc_id keep an entry each, in the order of their texts. An empty table gives
    an empty manifest. Further columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    width = max(shuffle_width(spark), 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = [k / width for k in range(1, width)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, 100 * width)).first()[0] or [])) if cuts else []
    folder = f"{shared_dir(spark)}/formloom/id-files-{uuid.uuid4().hex}"

    def run(batches):
        enc = encoder(tokenizer)
        bits = max(1, int(max(enc.vocab_size - 1, end_id)).bit_length())
        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        attempt = uuid.uuid4().hex
        end = np.array([end_id], np.uint32)
        names, ids_of, held, total = [], [], 0, 0
        at = [None, 0, 0]  # range, number of its next file, ids in its files so far

        def flush():
            nonlocal names, ids_of, held
            name = f"part-{at[0]:06d}-{at[1]:06d}-{attempt}.bits"
            with store.open_output_stream(f"{inner}/{name}") as f:
                for part in image(names, ids_of, bits):
                    f.write(part)
            row = pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int64()), pa.array([held], pa.int64()), pa.array([f"{folder}/{name}"])], names=["range_no", "file_no", "local_start", "n_ids", "path"])
            at[1:] = at[1] + 1, at[2] + held
            names, ids_of, held = [], [], 0
            return row

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                piece = batch.slice(a, 1000)
                for k, doc, ids in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), enc.encode(byte_rows(piece.column(2)))):
                    if k != at[0] or held >= file_ids:
                        if names:
                            yield flush()
                        if k != at[0]:
                            at = [k, 0, 0]
                    names.append(doc)
                    ids_of.append(np.concatenate((ids, end)))
                    held += len(ids) + 1
        if names:
            yield flush()

    dealt = docs.select(range_number(F.col("doc_id"), bounds).alias("range_no"), "doc_id", "text").repartitionById(width, F.col("range_no")).sortWithinPartitions("range_no", "doc_id", "text")
    return materialise(dealt.mapInArrow(lean(run), "range_no int, file_no int, local_start long, n_ids long, path string"), "id-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids as little-endian uint32."""
    spark = manifest.sparkSession
    totals = sorted((r.range_no, r.n) for r in manifest.groupBy("range_no").agg(F.sum("n_ids").alias("n")).collect())  # one row per range
    base, rows = 0, []
    for k, n in totals:
        rows.append((k, base))
        base += n
    bases = spark.createDataFrame(rows, "range_no int, base long")

    def run(batches):
        for batch in batches:
            for start, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(path) as f:
                    for docs, lens, ids in documents_of(f):
                        at = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
                        ids = ids.astype("<u4")
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + at[:-1]), pa.array(lens.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(at[-1])

    # one row per range: as small as the manifest's plan; the files themselves are dealt evenly over the tasks
    placed = manifest.join(F.broadcast(bases), "range_no").select((F.col("base") + F.col("local_start")).alias("start"), "path").repartition(shuffle_width(spark))
    return placed.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_bitpacked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
