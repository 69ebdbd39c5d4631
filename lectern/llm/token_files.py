"""Token ids in files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

1. Documents are range-partitioned by id and sorted; each task encodes its texts and packs the ids into blocks of
   whole documents, about BLOCK ids each. The blocks are kept as a table in the shared folder.
2. Counts of ids over all blocks give code lengths of at most LIMIT bits (package-merge), and those the canonical codes.
   Only counts by id come to the driver, as many as the vocabulary has ids at most.
3. A task turns each block into bits and writes them to files, which hold the code lengths, the documents, and the blocks
   with the bit offset of every STRIDE-th id. Blocks and the stretches between checkpoints decode without each other.
4. Readers decode all stretches of a file at once, one id of each per step, by a table of 2^LIMIT entries.

Words are encoded once in each worker: texts are cut where the tokenizer's own first step cuts as well, and the ids of the
pieces are looked up in a bounded table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, in_worker, scratch, span_hashes, utf8_of, written
from .sharding import before

LIMIT = 18
BLOCK = 1 << 16
STRIDE = 1 << 9
END = 2
MAGIC = b"LTF1"
KNOWN, KEPT = 1_000_000, 600_000
AT_ONCE = 5_000
SLICE_BYTES = 4_000_000


# Text to ids

# The pre-tokenizer's classes of bytes in plain texts: white space, ASCII letters and those of Latin-1, digits, punctuation.
WHITE, LETTER, DIGIT, MARK, HIGH, OTHER = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[32, *range(9, 14)]] = WHITE
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
CLASS[128:] = HIGH
ONE_CLASS = re.compile(rb"\x20?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
# White space beyond ASCII, in UTF-8.
ODD_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHAR = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - PRINTED))}


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in plain texts (UTF-8, one after the other, from begins on): nowhere but where the pre-tokenizer cuts too.

    It cuts before a space and a word, around other white space but for the last character of a run, and between letters,
    digits and punctuation. After an apostrophe letters may belong to it, and characters beyond Latin-1 have no known
    class, so that there is no cut beside them.
    """
    kind = CLASS[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    letters = after[~np.isin(data[after], (0x97, 0xB7))]
    kind[letters] = kind[letters - 1] = LETTER
    white = kind == WHITE
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    last = np.zeros(len(data), bool)
    last[np.r_[begins[1:], len(data)][begins < len(data)] - 1] = True
    was, will = np.r_[False, white[:-1]] & ~first[:-1], np.r_[white[1:], False] & ~last
    known = (kind >= LETTER) & (kind <= MARK)
    turn = np.r_[False, known[:-1] & known[1:] & (kind[:-1] != kind[1:]) & ~((data[:-1] == 39) & (kind[1:] == LETTER))]
    start = first[:-1] | turn
    start |= white & ~was  # a run of white space begins
    start |= white & ~will & ~last  # its last character, before something else
    start |= ~white & was & np.r_[False, data[:-1] != 32]  # what follows it, unless that is a space
    return np.flatnonzero(start)


class Pieces:
    """The ids of the pieces of texts. Pieces are found by their hashes in arrays; the most used stay known."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start, self.n, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self):
        return len(self.keys)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        # What the library returns of a piece is large, so that not many are encoded at once.
        return [e.ids for i in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Ids of new pieces with sorted keys. Those of one class are what the pre-tokenizer would leave whole."""
        tokenize = self.tokenizer.model.tokenize
        coded = [[t.id for t in tokenize(p.decode("latin-1").translate(BYTE_CHAR))] if ONE_CLASS(p) else None for p in pieces]
        several = [i for i, c in enumerate(coded) if c is None]
        for i, c in zip(several, self._whole([pieces[i].decode() for i in several])):
            coded[i] = c
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(n.sum()))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, place, keys), np.insert(self.number, place, np.arange(len(self.n), len(self.n) + len(n)))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(n) - n]
        self.n, self.flat, self.used = np.r_[self.n, n], np.r_[self.flat, flat], np.r_[self.used, np.zeros(len(n), np.int64)]

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        n = self.n[numbers]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - self.start[numbers], n)]

    def _trimmed(self) -> None:
        if len(self) > KNOWN or len(self.flat) > 8 * KNOWN:
            most = np.sort(np.argsort(-self.used, kind="stable")[:KEPT])
            most = most[np.cumsum(self.n[most]) <= 4 * KNOWN]
            key_of = np.empty(len(self.n), np.uint64)
            key_of[self.number] = self.keys
            flat, n, keys = self.gathered(most), self.n[most], key_of[most]
            order = np.argsort(keys)
            self.flat, self.n, self.start, self.used = flat, n, np.cumsum(n) - n, self.used[most] // 2
            self.keys, self.number = keys[order], order

    def _plain(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts, which begin at begins, in one array, and how many each has."""
        first = piece_starts(data, begins)
        last = np.r_[first[1:], len(data)]
        keys, one, of, seen = np.unique(span_hashes(data, first, last), return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)) if len(self.keys) else np.arange(len(keys))
        if len(new):
            whole = data.tobytes()
            self._learn(keys[new], [whole[a:b] for a, b in zip(first[one[new]].tolist(), last[one[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        numbers = self.number[at]
        self.used[numbers] += seen
        numbers = numbers[of]
        ids, upto = self.gathered(numbers), np.r_[0, np.cumsum(self.n[numbers])]
        edge = upto[np.searchsorted(first, np.r_[begins, len(data)])]
        self._trimmed()
        return ids, np.diff(edge)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (an Arrow array or list; null is empty) in one array, and how many each text has."""
        data, at = utf8_of(texts)
        whole = data.tobytes()
        odd = np.flatnonzero(CLASS[data] == OTHER)
        found = [m.start() for p in (ODD_WHITE, *map(re.compile, map(re.escape, self.special))) for m in p.finditer(whole)]
        # Other texts go through the library whole.
        others = np.unique(np.searchsorted(at, np.r_[odd, np.array(found, np.int64)], side="right") - 1)
        if not len(others):
            return self._plain(data, at[:-1])
        out, n = [], np.zeros(len(at) - 1, np.int64)
        done = 0
        for i in [*others.tolist(), len(n)]:
            if i > done:
                ids, n[done:i] = self._plain(data[at[done] : at[i]], at[done:i] - at[done])
                out.append(ids)
            if i < len(n):
                ids = self._whole([whole[at[i] : at[i + 1]].decode()])[0]
                out.append(np.array(ids, np.uint32))
                n[i] = len(ids)
            done = i + 1
        return np.concatenate(out), n


# Codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    merged, is_leaf = [], []
    level = leaf
    flags = np.ones(len(leaf), bool)
    for _ in range(limit):
        merged.append(level)
        is_leaf.append(flags)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[leaf, pairs]
        place = np.argsort(both, kind="stable")
        level, flags = both[place], place < len(leaf)
    length = np.zeros(len(leaf), np.int64)
    take = 2 * len(leaf) - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    own = lengths[order].astype(np.int64)
    if len(order):
        # Each code is the sum of the shares of those before it.
        top = int(own.max())
        share = np.int64(1) << (top - own)
        codes[order] = (np.cumsum(share) - share) >> (top - own)
    return codes


def packed(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """The bits of ids, first bit highest; the bit offset of every STRIDE-th id; the number of bits."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    bits = int(ends[-1]) if len(ids) else 0
    words = np.zeros(bits // 32 + 2, np.uint64)
    if len(ids):
        word, off = starts >> 5, starts & 31
        value = codes[ids].astype(np.uint64) << (64 - n - off).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        at = word[first]
        # Codes don't overlap, so sums are unions.
        words[at] += np.add.reduceat(value >> np.uint64(32), first)
        words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], starts[::STRIDE], bits


def table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each limit bits that may come next: id << 8 | length of the code they begin with."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    reach = np.int64(1) << (limit - lengths[order].astype(np.int64))
    out = np.zeros(1 << limit, np.uint32)
    filled = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order].astype(np.uint32), reach)
    out[: len(filled)] = filled
    return out


def unpacked(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, entries: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of stretches that begin at bit offsets of data and have counts ids, one id of each at a step."""
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(counts) else 0, np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, place = offsets[order].astype(np.int64), (ends - counts)[order]
    live = np.searchsorted(-counts[order], -np.arange(1, int(counts.max(initial=0)) + 1), side="right")
    padded = np.r_[data, np.zeros(8, np.uint8)]
    # The 32 bits from each byte on; limit + 7 of them are needed.
    window = padded[:-3].astype(np.uint32) << 24 | padded[1:-2].astype(np.uint32) << 16 | padded[2:-1].astype(np.uint32) << 8 | padded[3:]
    low, mask = np.uint32(32 - limit), np.uint32((1 << limit) - 1)
    for step, n in enumerate(live):
        own = at[:n]
        entry = entries[(window[own >> 3] >> (low - (own & 7).astype(np.uint32))) & mask]
        out[place[:n] + step] = entry >> 8
        own += entry & 255
    return out


# Files: magic, then zlib-packed parts, each with its length before it, then the bits of the blocks


def laid_out(lengths: np.ndarray, docs: list, blocks: list[tuple[bytes, np.ndarray, int]], start: int) -> bytes:
    """docs: (key, index of its first id in the file, number of ids). blocks: bits and marks as from packed, and the number of ids."""
    keys = json.dumps([d[0] for d in docs]).encode()
    places = np.array([d[1:] for d in docs], "<i8").reshape(-1, 2)
    sizes = np.array([(len(b), n) for b, _, n in blocks], "<i8").reshape(-1, 2)
    marks = np.concatenate([m for _, m, _ in blocks]) if blocks else np.zeros(0, np.int64)
    out = [MAGIC, struct.pack("<q", start)]
    for part in (lengths.astype(np.uint8).tobytes(), keys, places.tobytes(), sizes.tobytes(), marks.astype("<i4").tobytes()):
        part = zlib.compress(part, 1)
        out += [struct.pack("<q", len(part)), part]
    return b"".join([*out, *[b for b, _, _ in blocks]])


def loaded(content: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """The number of ids before the file, keys, places, and ids of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    at, parts = 12, []
    for _ in range(5):
        (n,) = struct.unpack_from("<q", content, at)
        parts.append(zlib.decompress(content[at + 8 : at + 8 + n]))
        at += 8 + n
    lengths = np.frombuffer(parts[0], np.uint8)
    places, sizes, marks = np.frombuffer(parts[2], "<i8").reshape(-1, 2), np.frombuffer(parts[3], "<i8").reshape(-1, 2), np.frombuffer(parts[4], "<i4")
    per_block = -(-sizes[:, 1] // STRIDE)
    base = np.repeat((np.cumsum(sizes[:, 0]) - sizes[:, 0]) * 8, per_block)
    counts = np.full(len(marks), STRIDE, np.int64)
    last = np.cumsum(per_block) - 1
    counts[last] = sizes[:, 1] - (per_block - 1) * STRIDE
    ids = unpacked(np.frombuffer(content, np.uint8, offset=at), base + marks, counts, table(lengths))
    return struct.unpack_from("<q", content, 4)[0], json.loads(parts[1]), places, ids


# Jobs

BLOCKS = "part int, block bigint, part_start bigint, n_ids bigint, ids binary, docs array<struct<key:string,first:bigint,n:bigint>>"


def blocks_of(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", end: int = END, bytes_per_part: int = 24 << 20) -> DataFrame:
    """The blocks of all documents in ascending order of doc, null first; rows with equal ids by the hash of their texts."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long"))).first()[0] or 0
    parts = max(1, -(-total // bytes_per_part), min(12, total // (1 << 18)))
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(int(parts), "doc", "tie").sortWithinPartitions("doc", "tie")
    rows = rows.select(F.spark_partition_id().alias("part"), F.col("doc").cast("string").alias("key"), "text")
    doc_type = pa.list_(pa.struct([("key", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("docs", doc_type)])

    def run(batches):
        known = in_worker(("tokens", path), lambda: Pieces(path), large=True)
        block, start = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            keys = batch.column(1).to_pylist()
            for at, to in byte_slices(batch.column(2), SLICE_BYTES):
                ids, n = known.encode(batch.column(2).slice(at, to - at))
                ids, n = np.insert(ids, np.cumsum(n), end), n + 1
                first = np.cumsum(n) - n
                # Documents that begin in the same stretch of BLOCK ids share a block.
                cuts = np.flatnonzero(np.r_[True, np.diff(first // BLOCK) > 0, True])
                for a, b in zip(cuts, cuts[1:]):
                    own = ids[first[a] : first[b - 1] + n[b - 1]]
                    docs = [{"key": keys[at + i], "first": start + int(first[i]), "n": int(n[i])} for i in range(a, b)]
                    yield pa.RecordBatch.from_pylist([{"part": part, "block": block, "part_start": start + int(first[a]), "n_ids": len(own), "ids": own.astype("<u4" if own.max() > 65535 else "<u2").tobytes(), "docs": docs}], schema)
                    block += 1
                start += len(ids)

    return written(rows.mapInArrow(run, BLOCKS), "token-blocks")


def counted(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs in all blocks."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0), batch.column(1).to_pylist()):
                own = np.bincount(ids_of(ids.as_buffer(), n))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = blocks.select("ids", "n_ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def ids_of(data, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if memoryview(data).nbytes == 2 * n else "<u4", n)


def write(blocks: DataFrame, folder: str) -> DataFrame:
    """Writes the blocks to files in folder; (path, part, block, n_ids, n_bytes) of each."""
    lengths = code_lengths(counted(blocks))
    # A row for each part; written, so that Spark knows its size when it chooses the join.
    starts = written(before(blocks.select("part", "n_ids"), [], "part", "n_ids"), "token-starts")
    rows = blocks.join(starts, "part").sortWithinPartitions("part", "block")
    rows = rows.select("part", "block", (F.col("_x_before") + F.col("part_start")).alias("start"), "part_start", "n_ids", "ids", "docs")
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        codes, n_max = canonical(lengths), 64
        held, after = [], None

        def put():
            first = held[0]
            docs = [(d["key"], d["first"] - first["part_start"], d["n"]) for r in held for d in r["docs"]]
            content = laid_out(lengths, docs, [r["made"] for r in held], first["start"])
            path, temporary = f"{base}/{first['part']:06d}-{first['block']:08d}.ltf", f"{base}/.{uuid.uuid4().hex}"
            with files.open_output_stream(temporary, compression=None) as out:
                out.write(content)
            files.move(temporary, path)
            return pa.RecordBatch.from_pylist([{"path": path, "part": first["part"], "block": first["block"], "n_ids": sum(r["n_ids"] for r in held), "n_bytes": len(content)}], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                # A file holds blocks that follow each other.
                if held and ((r["part"], r["block"]) != after or len(held) >= n_max):
                    yield put()
                    held = []
                ids = ids_of(r.pop("ids"), r["n_ids"])
                bits, marks, _ = packed(ids, codes, lengths)
                r["made"] = (bits, marks, len(ids))
                held.append(r)
                after = (r["part"], r["block"] + 1)
        if held:
            yield put()

    return written(rows.mapInArrow(run, "path string, part int, block bigint, n_ids bigint, n_bytes bigint"), "token-files")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids) for each document of the files in folder; ids as little-endian 32-bit integers."""
    schema = pa.schema([("key", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                before, keys, places, ids = loaded(content.as_py())
                ids = ids.astype("<u4")
                for i in range(0, len(keys), 2000):
                    rows = [(k, before + a, n, ids[a : a + n].tobytes()) for k, (a, n) in zip(keys[i : i + 2000], places[i : i + 2000].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ltf").load(folder).select("content")
    return files.mapInArrow(run, "key string, start bigint, n_tokens bigint, ids binary")


def tokenised(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", end: int = END) -> str:
    """Writes the ids of all documents, each with the end id after it, and returns the folder of the files.

    Null and empty texts have the end id alone. Rows with a null id come first; rows with the same id stand together.
    An empty table writes no file. Other columns play no part.
    """
    folder = scratch(docs.sparkSession, "tokens")
    write(blocks_of(docs, path, doc, text, end), folder)
    return folder


def op4_token_files(docs: DataFrame, path: str) -> DataFrame:
    folder = tokenised(docs, path)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    back = read(spark, folder) if has_files(spark, folder) else spark.createDataFrame([], "key string, start bigint, n_tokens bigint, ids binary")
    return back.select(F.col("key").cast(kind).alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def has_files(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
