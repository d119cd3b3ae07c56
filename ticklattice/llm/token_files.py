"""Token-ID files coded by a static range asymmetric numeral system (rANS).

A file set is a Parquet dataset with one row per block and one small table of
frequencies that all blocks share. Blocks hold `BLOCK` ids each (the last of a part
fewer), dealt over `LANES` interleaved coders, and are coded independently of each
other. Every `CHECKPOINT` rows of a block the coders' states and the place in the
payload are kept, so that decoding can start there; payload and ids have checksums.

Parts ascend by doc_id, blocks by number within a part, documents within a block.
Null text counts as empty and gives the end id alone; a null doc_id sorts first;
rows with equal doc_id stay separate; an empty table gives no blocks; other columns
are ignored. Long texts span blocks. Rows with one doc_id, or none, are dealt by a
hash of their text too, so many of them spread over parts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import new_path, slices, stored
from .token_ids import TextEncoder

BLOCK, LANES, CHECKPOINT = 65_536, 32, 512
SCALE = 18  # frequencies add up to 2**SCALE
LOW = np.uint64(1 << 31)
_32, _S = np.uint64(32), np.uint64(SCALE)

_RAW = "part int, block long, first_doc long, continued boolean, doc_ids array<long>, begins array<int>, n int, ids binary, tally binary"
_CODED = "part int, block long, first_doc long, continued boolean, doc_ids array<long>, begins array<int>, n int, states binary, places binary, payload binary, payload_crc32 long, ids_crc32 long"


@dataclass(frozen=True)
class TokenFiles:
    """Where a file set lies: blocks and the shared table of frequencies."""

    blocks: str
    frequencies: str


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, keeps_spaces: bool) -> TextEncoder:
    """One per Python worker, so that later tasks find the chunks of earlier ones."""
    key = (path, keeps_spaces)
    if key not in _encoders:
        _encoders[key] = TextEncoder(path, keeps_spaces)
    return _encoders[key]


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents in doc_id order as blocks of ids (16 bits each where the vocabulary allows, else 32); a row for each block.

    tally, in the last row of a partition, has how often each id occurs in the partition: pairs of 64-bit integers."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def blocks(batches):
        enc = encoder(tokenizer, True)
        held, size, part, block = [], 0, None, 0  # ids not yet in a block
        open_ids, open_begins, first_doc = [], [], 0
        kind, seen = enc.kind, np.zeros(0, np.int64)

        def block_of(count):
            nonlocal held, size, block, open_ids, open_begins, first_doc
            flat = np.concatenate(held)
            row = [part, block, first_doc, not open_begins or open_begins[0] > 0]
            now = sum(b < count for b in open_begins)
            row += [open_ids[:now], open_begins[:now], count, flat[:count].tobytes(), None]
            open_ids, open_begins = open_ids[now:], [b - count for b in open_begins[now:]]
            held, size, block, first_doc = [flat[count:]], size - count, block + 1, first_doc + now
            return row

        def as_batch(rows):
            schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first_doc", pa.int64()), ("continued", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("begins", pa.list_(pa.int32())), ("n", pa.int32()), ("ids", pa.binary()), ("tally", pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                if part is None:
                    part = batch.column("part")[0].as_py()
                ids, counts = enc.encode(batch.column("text").to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)  # after each document
                counts = counts + 1
                open_begins += (size + np.cumsum(counts) - counts).tolist()
                open_ids += batch.column("doc_id").to_pylist()
                got = np.bincount(ids)
                seen = got + np.pad(seen, (0, len(got) - len(seen))) if len(got) > len(seen) else seen + np.pad(got, (0, len(seen) - len(got)))
                held.append(ids.astype(kind))
                size += len(ids)
                rows = []
                while size >= BLOCK:
                    rows.append(block_of(BLOCK))
                if rows:
                    yield as_batch(rows)
        if part is not None:
            last = block_of(size)
            found = np.flatnonzero(seen)
            last[-1] = np.stack([found, seen[found]], axis=1).astype("<i8").tobytes()
            yield as_batch([last])

    return dealt.mapInArrow(blocks, _RAW)


def frequencies(raw: DataFrame) -> DataFrame:
    """How often each id occurs in all blocks: (token_id, n); as many rows as the vocabulary has ids at most."""

    def count(batches):
        for batch in batches:
            for x in batch.column("tally").drop_null():
                pairs = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["token_id", "n"])

    return raw.where("tally is not null").select("tally").mapInArrow(count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to 2**SCALE, 1 at least where a count is above 0."""
    total, most = int(counts.sum()), 1 << SCALE
    if (counts > 0).sum() > most:
        raise ValueError("more distinct ids than 2**SCALE")
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, (counts.astype(float) * most / total).astype(np.int64)), 0)
    while (over := int(out.sum()) - most) != 0:  # the most frequent give or take
        order = np.argsort(-out, kind="stable")[: max(1, min(abs(over), int((out > 1).sum())))]
        step = max(1, abs(over) // len(order))
        out[order] -= np.minimum(np.sign(over) * step, out[order] - 1)
    return out


def encode_blocks(ids: list[np.ndarray], freq: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(states, places, payload) of each block; states and places have an entry for each checkpoint."""
    f_of = np.append(freq, 1 << SCALE).astype(np.uint64)  # the last stands for no symbol: coding it changes nothing
    c_of = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
    n = np.array([len(x) for x in ids])
    rows = -(-int(n.max()) // LANES)
    sym = np.full((len(ids), rows * LANES), len(freq), np.int32)
    for i, x in enumerate(ids):
        sym[i, : len(x)] = x
    sym = np.ascontiguousarray(sym.reshape(len(ids), rows, LANES).transpose(1, 0, 2))  # by row
    x = np.full((len(ids), LANES), LOW)
    words, written = np.zeros(sym.shape, np.uint32), np.zeros(sym.shape, bool)
    states = {0: x}
    top = np.uint64(63 - SCALE)
    for r in range(rows - 1, -1, -1):
        f, c = f_of[sym[r]], c_of[sym[r]]
        out = x >= f << top
        words[r], written[r] = x, out  # the low 32 bits
        x = np.where(out, x >> _32, x)
        q = x // f
        x = (q << _S) + (x - q * f) + c
        if r % CHECKPOINT == 0:
            states[r] = x
    result = []
    for i in range(len(ids)):
        marks = range(0, max(1, -(-int(n[i]) // LANES)), CHECKPOINT)
        per_row = np.concatenate([[0], np.cumsum(written[:, i].sum(axis=1))])
        result.append((np.concatenate([states[r][i] for r in marks]).astype("<u8").tobytes(), per_row[list(marks)].astype("<u4").tobytes(), words[:, i][written[:, i]].astype("<u4").tobytes()))
    return result


def decode_blocks(n: list[int], states: list[bytes], places: list[bytes], payload: list[bytes], freq: np.ndarray) -> list[np.ndarray]:
    """The ids of each block; all stretches between checkpoints are decoded side by side."""
    symbol_at = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    f_of, c_of = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    words = np.frombuffer(b"".join(payload) + bytes(4), "<u4")
    base = np.cumsum([0] + [len(x) // 4 for x in payload[:-1]])
    per = [len(x) // 4 for x in places]
    x = np.frombuffer(b"".join(states), "<u8").reshape(-1, LANES).copy()
    at = np.concatenate([np.frombuffer(p, "<u4").astype(np.int64) + b for p, b in zip(places, base, strict=True)])
    left = np.concatenate([np.minimum(k - np.arange(m) * LANES * CHECKPOINT, LANES * CHECKPOINT) for k, m in zip(n, per, strict=True)])
    rows = -(-int(left.max()) // LANES)
    out = np.zeros((rows, len(left), LANES), np.uint32)
    lane, low = np.arange(LANES), np.uint64((1 << SCALE) - 1)
    for r in range(rows):
        live = r * LANES + lane < left[:, None]
        slot = x & low
        s = symbol_at[slot.astype(np.int64)]
        out[r] = s
        y = f_of[s] * (x >> _S) + slot - c_of[s]
        more = live & (y < LOW)
        place = at[:, None] + np.cumsum(more, axis=1) - 1
        y = np.where(more, (y << _32) | words[np.where(more, place, 0)], y)
        at += more.sum(axis=1)
        x = np.where(live, y, x)
    flat, result, k = np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(left), -1), [], 0
    for count, m in zip(n, per, strict=True):
        result.append(np.concatenate([flat[k + j, : left[k + j]] for j in range(m)])[:count])
        k += m
    return result


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> TokenFiles:
    """Encodes all documents with the tokenizer at `tokenizer` and writes the coded files under path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    raw = stored(raw_blocks(docs, tokenizer, end_id), "raw-ids")
    files = TokenFiles(f"{path}/blocks", f"{path}/frequencies")
    stored_counts = frequencies(raw).collect()  # bounded by the vocabulary
    counts = np.zeros(1 + max((r.token_id for r in stored_counts), default=0), np.int64)
    for r in stored_counts:
        counts[r.token_id] = r.n
    freq = quantised(counts)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(freq) if x], "token_id long, frequency long").coalesce(1).write.parquet(files.frequencies)

    def code(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 96):
                batch = whole.slice(k, 96)
                ids = [np.frombuffer(x.as_buffer(), "<u2" if len(x.as_buffer()) == 2 * n else "<u4") for x, n in zip(batch.column("ids"), batch.column("n").to_pylist(), strict=True)]
                coded = encode_blocks(ids, freq)
                more = [pa.array([x[j] for x in coded], pa.binary()) for j in range(3)]
                crcs = [pa.array([zlib.crc32(x[2]) for x in coded], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more, *crcs], names=[*batch.schema.names[:-1], "states", "places", "payload", "payload_crc32", "ids_crc32"])

    raw.drop("tally").mapInArrow(code, _CODED).write.parquet(files.blocks)
    return files


def _frequency_array(spark: SparkSession, files: TokenFiles) -> np.ndarray:
    found = spark.read.schema("token_id long, frequency long").parquet(files.frequencies).collect()  # bounded by the vocabulary
    freq = np.zeros(1 + max((r.token_id for r in found), default=0), np.int64)
    for r in found:
        freq[r.token_id] = r.frequency
    return freq


def read_token_files(spark: SparkSession, files: TokenFiles, digests: bool = False) -> DataFrame:
    """Pieces of documents as the files have them: part, ordinal (of the document in its part), doc_id, block, begin (ids
    of its part before the piece), ids (binary, uint32), or with digests n and crc (of these bytes) in their place. A
    checksum that does not hold raises an error."""
    freq = _frequency_array(spark, files)

    def pieces(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 96):
                b = whole.slice(k, 96).to_pydict()
                bad = [i for i, x in enumerate(b["payload"]) if zlib.crc32(x) != b["payload_crc32"][i]]
                got = [] if bad else decode_blocks(b["n"], b["states"], b["places"], b["payload"], freq)
                bad += [i for i, x in enumerate(got) if zlib.crc32(x.astype("<u4").tobytes()) != b["ids_crc32"][i]]
                if bad:
                    raise ValueError(f"checksum of block {b['block'][bad[0]]} of part {b['part'][bad[0]]} does not hold")
                rows = {x: [] for x in names_of}
                for i, ids in enumerate(got):
                    begins, names = list(b["begins"][i]), list(b["doc_ids"][i])
                    cuts = ([0] if b["continued"][i] else []) + begins
                    names = ([None] if b["continued"][i] else []) + names
                    first = b["first_doc"][i] - b["continued"][i]
                    for j, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
                        piece = ids[lo:hi].astype("<u4").tobytes()
                        content = (hi - lo, zlib.crc32(piece)) if digests else (piece,)
                        for key, v in zip(rows, (b["part"][i], first + j, names[j], b["block"][i], b["block"][i] * BLOCK + lo, *content), strict=True):
                            rows[key].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=names_of)

    names_of = ["part", "ordinal", "doc_id", "block", "begin", *(["n", "crc"] if digests else ["ids"])]
    kinds = [pa.int32(), *[pa.int64()] * 4, *([pa.int64()] * 2 if digests else [pa.binary()])]
    return spark.read.schema(_CODED).parquet(files.blocks).mapInArrow(pieces, "part int, ordinal long, doc_id long, block long, begin long, " + ("n long, crc long" if digests else "ids binary"))


#: The reversed CRC-32 polynomial (fixed value).
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """a * b as polynomials over GF(2) modulo the CRC-32 polynomial, bit-reversed."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of strings in a row, from (CRC-32, bytes) of each."""
    total = parts[0][0]
    for crc, size in parts[1:]:
        shift, power, n = 1 << 31, 1 << 23, size  # x**0, and x**8 for one byte
        while n:
            if n & 1:
                shift = _times(shift, power)
            power, n = _times(power, power), n >> 1
        total = _times(shift, total) ^ crc
    return total


def document_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone."""
    blocks = spark.read.schema(_CODED).parquet(files.blocks)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each part

    def joined(batches):
        """Texts in one block have their checksum already; others' are put together from their pieces'."""
        for b in batches:
            parts = b.column("pieces")
            begin, n, crc = (x.to_numpy(zero_copy_only=False) for x in (parts.offsets, parts.flatten().field("n"), parts.flatten().field("crc")))
            begin = begin - begin[0]
            out = crc[begin[:-1]]
            for i in np.flatnonzero(np.diff(begin) > 1):
                out[i] = crc32_joined([(int(c), int(m) * 4) for c, m in zip(crc[begin[i] : begin[i + 1]], n[begin[i] : begin[i + 1]], strict=True)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "doc_id", "begin", "n_tokens")), pa.array(out, pa.int64())], names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    pieces = read_token_files(spark, files, digests=True)
    docs = pieces.groupBy("part", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"))
    one = docs.drop("ordinal").mapInArrow(joined, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return one.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op_query(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The digest query: encode, write, read back."""
    return document_digests(spark, write_token_files(docs, tokenizer, end_id))
