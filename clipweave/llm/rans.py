"""Token-ID output: a file format of blocks coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks. A block holds whole documents in ascending order of ids
and is coded by itself: token number t belongs to lane t mod LANES, and all lanes step together over arrays. Every
CHECKPOINT steps the lanes' states and the place in the words are kept, so that a block can be decoded from there too. Each
block carries a crc32 of its bytes and one of its tokens.

On storage it is a folder of Parquet tables, which Spark commits and reads on any store: ``table`` (symbol, freq),
``blocks`` (shard, seq, start within the shard, documents' ids and lengths, payload) and ``shards`` (shard, start). A
payload is: header ``<4sIIQQI`` (magic, lanes, steps between checkpoints, tokens, words, crc32 of the tokens as
little-endian unsigned 32-bit), the lanes' first states, for each checkpoint the states and the place, all as unsigned
64-bit, then the words as unsigned 32-bit, then the crc32 of all that.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, long_doc, partitions, slices, table_path, utf8

SCALE = 20
LANES, BLOCK_TOKENS, CHECKPOINT = 1024, 1 << 18, 128
MAGIC, HEADER = b"CWR1", struct.Struct("<4sIIQQI")
_LOW, _BASE = np.uint64(0xFFFFFFFF), np.uint64(1 << 32)
_M, _ROOM, _HALF, _MASK = np.uint64(SCALE), np.uint64(64 - SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)
#: Words whose ids a worker keeps.
CACHE_WORDS = 1_200_000


def frequencies(counts: dict[int, int], vocab: int) -> np.ndarray:
    """Slots of 2**SCALE for each symbol, in proportion to its count, one at least where it occurs; never all for one."""
    total, size = sum(counts.values()), 1 << SCALE
    freq = np.zeros(vocab, np.int64)
    for s, c in counts.items():
        freq[s] = max(1, c * size // total)
    if len(counts) < 2:  # a second symbol, so that no frequency fills the whole range
        freq[next((s for s in range(vocab) if s not in counts), 0)] += 1
    spare = size - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while spare:
        for s in order:
            step = spare if spare > 0 else -min(-spare, int(freq[s]) // 2)
            freq[s] += step
            spare -= step
            if not spare:
                break
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, tokens: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
        tokens = tokens.astype(np.int64)
        x, words, marks, written = np.full(lanes, _BASE), [], [], 0
        for s in range(-(-len(tokens) // lanes) - 1, -1, -1):
            t = tokens[s * lanes : (s + 1) * lanes]
            f, y = self.freq[t], x[: len(t)]
            over = y >= f << _ROOM
            out = (y[over] & _LOW).astype("<u4")
            words.append(out)
            written += len(out)
            y = np.where(over, y >> _HALF, y)
            q = y // f
            x[: len(t)] = (q << _M) + (y - q * f) + self.cum[t]
            if s and s % every == 0:
                marks.append((x.copy(), written))
        body = b"".join([
            HEADER.pack(MAGIC, lanes, every, len(tokens), written, zlib.crc32(tokens.astype("<u4").tobytes())),
            x.astype("<u8").tobytes(),
            *(m.astype("<u8").tobytes() + struct.pack("<Q", written - w) for m, w in reversed(marks)),
            *(w.tobytes() for w in reversed(words)),
        ])
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Tokens of a block; ``first`` and ``last`` number its parts between checkpoints."""
        body, (crc,) = payload[:-4], struct.unpack("<I", payload[-4:])
        magic, lanes, every, n, n_words, check = HEADER.unpack_from(body)
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        steps = -(-n // lanes)
        parts = max(1, -(-steps // every))
        at = HEADER.size + 8 * lanes * parts + 8 * (parts - 1)
        words = np.frombuffer(body, "<u4", n_words, at)
        begin, place = HEADER.size, 0
        if first:
            begin += 8 * lanes + (first - 1) * (8 * lanes + 8)
            place = struct.unpack_from("<Q", body, begin + 8 * lanes)[0]
        x = np.frombuffer(body, "<u8", lanes, begin).copy()
        last = parts if last is None else min(last, parts)
        out = np.zeros(max(0, min(n, last * every * lanes) - first * every * lanes), np.uint32)
        for s in range(first * every, min(steps, last * every)):
            m = min(lanes, n - s * lanes)
            y = x[:m]
            slot = y & _MASK
            t = self.symbol[slot]
            y = self.freq[t] * (y >> _M) + slot - self.cum[t]
            low = np.flatnonzero(y < _BASE)
            y[low] = (y[low] << _HALF) | words[place : place + len(low)]
            place += len(low)
            x[:m] = y
            out[(s - first * every) * lanes : (s - first * every) * lanes + m] = t
        if first == 0 and last == parts and zlib.crc32(out.astype("<u4").tobytes()) != check:
            raise ValueError("tokens do not match their checksum")
        return out


#: Printable ASCII and the letters of Latin-1: what is normalised and parted below as the tokenizer does it.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The tokenizer's own steps for which that holds (fixed values).
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Words(dict):
    """Ids of words by the tokenizers library, as little-endian bytes. Words are parted at ASCII spaces, which the tokenizer drops.

    A word is encoded when it is first met. One of plain letters goes in pieces to the library's model; any other one, with
    special tokens, marks or other scripts, through the library's whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        steps = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        parts = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_pieces = normal == _NORMAL and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _PATTERN}
        self.tokens = self.tokenizer.model.tokenize
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.by_pieces and _PLAIN.fullmatch(text) and not self.special(text):
            pieces = _PIECES.findall(text.lower())
            if not word.isascii():
                pieces = [p.translate(self.letters) for p in pieces]
            ids = [t.id for p in pieces for t in self.tokens(p)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = out = array(self.code, ids).tobytes()
        return out

    def encode(self, texts: list[bytes | None], end: int) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        tail = array(self.code, [end]).tobytes()
        return [b"".join(map(self.__getitem__, (t or b"").split())) + tail for t in texts]


_LOADED: dict[str, _Words] = {}


def words(path: str) -> _Words:
    if path not in _LOADED:
        _LOADED[path] = _Words(path)
    return _LOADED[path]


def _tokenize(path: str, end: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words(path)
        for batch in it:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(model.encode(utf8(part.column(1)), end), pa.binary())], names=["doc_id", "ids"])

    return run


def _count(dtype: str, vocab: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in it:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=vocab) if len(x.as_buffer()) > vocab else 0
                if len(x.as_buffer()) <= vocab:
                    np.add.at(total, np.frombuffer(x.as_buffer(), dtype), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    return run


def _write(dtype: str, freq: np.ndarray, lanes: int, block_tokens: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(freq), TaskContext.get().partitionId()
        ids, arrays, n, start, seq = [], [], 0, 0, 0

        def block():
            lens = np.array([len(a) for a in arrays], np.int64)
            return pa.RecordBatch.from_pydict({"shard": [shard], "seq": [seq], "start": [start], "n_tokens": [n], "doc_ids": [np.array(ids, "<i8").tobytes()], "lengths": [lens.astype("<i8").tobytes()], "payload": [coder.encode(np.concatenate(arrays), lanes)]}, schema=_BLOCK)

        for batch in it:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                arrays.append(np.frombuffer(x.as_buffer(), dtype))
                n += len(arrays[-1])
                if n >= block_tokens:
                    yield block()
                    ids, arrays, start, n, seq = [], [], start + n, 0, seq + 1
        if ids:
            yield block()

    return run


_BLOCK = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])
_BLOCK_DDL = "shard int, seq int, start long, n_tokens long, doc_ids binary, lengths binary, payload binary"


def _starts(blocks: DataFrame) -> DataFrame:
    """(shard, shard_start) from the blocks' token counts: sums before each thousand of shards, then within it."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("far", F.expr("shard div 1000"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = sizes.groupBy("far").agg(F.sum("n").alias("n")).select("far", before(Window.orderBy("far")).alias("base"))  # a row per thousand shards
    near = sizes.join(far, "far").withColumn("own", before(Window.partitionBy("far").orderBy("shard")))
    return near.select("shard", (F.col("base") + F.col("own")).alias("shard_start"))


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end: int = 1, lanes: int = LANES, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode every whole text, append ``end`` and write the format to the folder ``path``; returns ``path``.

    A null or empty text has the end id alone. Rows without an id are left out; rows that repeat an id are kept beside each other.
    Other columns are not looked at. Documents are never split between blocks, so the longest one bounds a block.
    The frequency table has a row per symbol that occurs, at most the vocabulary's size, and is the only thing sent to the driver.
    """
    spark, model = docs.sparkSession, words(tokenizer)
    dtype, vocab = model.dtype.str, max(model.size, end + 1)
    tokens = cut(long_doc(docs).mapInArrow(_tokenize(tokenizer, end), "doc_id long, ids binary"), "tokens")
    counted = tokens.select("ids").mapInArrow(_count(dtype, vocab), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts = {r["symbol"]: r["n"] for r in counted.collect()}
    freq = frequencies(counts, vocab) if counts else np.zeros(vocab, np.int64)
    spark.createDataFrame([(int(s), int(freq[s])) for s in np.flatnonzero(freq)], "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    n = partitions(spark, sum(counts.values()), 16 << 20)
    blocks = tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_write(dtype, freq, lanes, block_tokens), _BLOCK_DDL)
    blocks.write.parquet(f"{path}/blocks")
    _starts(spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")).write.parquet(f"{path}/shards")
    return path


def _read(freq: np.ndarray, digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in it:
            for r in batch.to_pylist():
                ids, lens = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lengths"], "<i8")
                tokens, ends = coder.decode(r["payload"]), np.cumsum(lens)
                docs = [tokens[b - m : b].astype("<u4") for b, m in zip(ends.tolist(), lens.tolist(), strict=True)]
                out = pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()) if digest else pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ends - lens + r["start"] + r["shard_start"]), pa.array(lens), out], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder, or with ``digest`` (.., ids_crc32) instead of the ids. Blocks are decoded in parallel."""
    rows = spark.read.schema("symbol long, freq long").parquet(f"{path}/table").collect()
    freq = np.zeros(max((r["symbol"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r["symbol"]] = r["freq"]
    shards = spark.read.schema("shard int, shard_start long").parquet(f"{path}/shards")  # joined by its size, as Spark sees fit
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks").join(shards, "shard")
    last = "ids_crc32 long" if digest else "ids array<long>"
    return blocks.select("start", "shard_start", "doc_ids", "lengths", "payload").mapInArrow(_read(freq, digest), f"doc_id long, start long, n_tokens long, {last}")


def token_output(docs: DataFrame, tokenizer: str, *, end: int = 1) -> DataFrame:
    """Write to the shared folder, read back, and return (doc_id, start, n_tokens, ids_crc32) per document."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer, table_path(spark, "token-files"), end=end), digest=True)
