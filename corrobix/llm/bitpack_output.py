"""Token-id output in fixed-width bit packing.

Format: a table of blocks, one row each, written by Spark's Parquet writer (atomic task commits, any Hadoop file system).
A block holds whole documents in ascending doc_id order: shard and block number, bits per id, doc_ids, offsets (ids before each
document inside the block, one more at the end) and the payload, ids packed little-endian in the fewest bits that hold the
vocabulary. Id i of a block starts at bit i * bits, so any document or id is read without unpacking the rest.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BROADCAST_IDS, Table, bounded_batches, give_back, hash_spans, kept, turn_to, utf8, word_bounds

END_ID = 2
_BLOCK_IDS = 1 << 16
_CACHE_WORDS = 250_000
_BLOCKS = "shard long, block long, bits long, doc_ids array<long>, offsets array<long>, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    cells = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(cells.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a payload, reading only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, -(-stop * bits // 8) - first, first)
    cells = np.unpackbits(raw, bitorder="little")[start * bits - first * 8 :][: (stop - start) * bits].reshape(-1, bits)
    return (cells.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The byte-level alphabet's rule: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordTokenizer:
    """The library's encoding of whole texts, with a bounded table of known words.

    Only valid for tokenizers that lower the case, drop white space and never merge across it or across a letter and a mark,
    and that have `separator` as a special token; the caller names such a file.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        self.kind = np.dtype("<u2" if bits_of(self.tokenizer) <= 16 else "<u4")
        self.known: dict[bytes, bytes] = {}

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of each text (rows of raw from off) as little-endian integers of `kind`: each distinct word is looked up once."""
        starts, ends, rows = word_bounds(raw, off)
        _, first, at = np.unique(hash_spans(raw, starts, ends, lower=True), return_index=True, return_inverse=True)
        body = raw.tobytes().lower()  # bytes: only A-Z change
        ids = self._lookup([body[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        width = self.kind.itemsize
        sizes = np.array([len(x) // width for x in ids], np.int64)
        flat, begin, counts = np.frombuffer(b"".join(ids), self.kind), np.cumsum(sizes) - sizes, sizes[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        out = flat[np.arange(upto[-1]) + np.repeat(begin[at] - upto[:-1], counts)].tobytes()
        cut = (width * upto[rows]).tolist()
        return [out[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]

    def _lookup(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        full = len(known) >= _CACHE_WORDS
        new = {w for w in words if w not in known}
        marked = [w for w in new if w[-1] in b",." and len(w) > 1 and w[-2:-1].isalnum()]
        parts = new.difference(marked) | {w[:-1] for w in marked} | {b",", b"."}
        parts = [w for w in parts if w not in known]
        for at in range(0, len(parts), 4_000):
            self._learn(parts[at : at + 4_000])
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1:]]
        out = [known[w] for w in words]
        if full:
            for w in new.union(parts):
                del known[w]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Encode words: plain Latin letters by the model itself, the others in one text, told apart by the separator unless they hold it."""
        odd, tokenize, code = self.separator.encode()[:2], self.tokenizer.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        plain = []
        for w in words:
            if w.isalpha():
                self.known[w] = struct.pack(f"<{len(ids)}{code}", *ids) if (ids := [t.id for t in tokenize(w.decode())]) else b""
            elif _LATIN.fullmatch(text := w.decode()):  # lowering and normal form are simple for these
                ids = [t.id for t in tokenize(text.lower().encode().decode("latin-1").translate(_BYTE_CHARS))]
                self.known[w] = struct.pack(f"<{len(ids)}{code}", *ids)
            elif odd not in w:
                plain.append(w)
        ids = np.array(self.tokenizer.encode_batch_fast([self.separator.join(w.decode() for w in plain)], add_special_tokens=False)[0].ids if plain else [], np.int64)
        cut = np.flatnonzero(ids == self.separator_id)
        for w, own in zip(plain, np.split(ids.astype(self.kind), cut), strict=True) if plain else ():
            self.known[w] = (own[1:] if len(own) and own[0] == self.separator_id else own).tobytes()
        for w in words:
            if odd in w:
                self.known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, self.kind).tobytes()


class TextTokenizer:
    """The library's encoding of whole texts as it is, for any tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if bits_of(self.tokenizer) <= 16 else "<u4")

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of each text (rows of raw from off) as little-endian integers of `kind`."""
        body, cut = raw.tobytes(), off.tolist()
        texts = [body[s:e].decode() for s, e in zip(cut[:-1], cut[1:], strict=True)]
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def bits_of(tokenizer: Tokenizer) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, max(END_ID, *tokenizer.get_vocab(with_added_tokens=True).values()).bit_length())


def shared_tokenizer(path: str, by_words: bool) -> WordTokenizer | TextTokenizer:
    """One tokenizer for all tasks of a worker."""
    own = kept("tokens")
    if (path, by_words) not in own:
        own[path, by_words] = (WordTokenizer if by_words else TextTokenizer)(path)
    return own[path, by_words]


def write_packed(docs: DataFrame, tokenizer_path: str, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", by_words: bool = True) -> Table:
    """Tokenise whole texts, append END_ID to each document and write blocks in ascending doc_id order.

    `by_words` looks each distinct word up once, for tokenizers that `WordTokenizer` is valid for; others take whole texts.
    Null and empty texts give the end id alone. Repeated doc_ids are each written, side by side; null ids come first. Other
    columns are not read. An empty table writes no blocks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bits = bits_of(Tokenizer.from_file(tokenizer_path))
    give_back()  # the driver needs the vocabulary's size alone
    shards = n_shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]  # ranges are cut by a text's head: sampled keys go to the driver
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).repartitionByRange(shards, order[0], F.substring("text", 1, 64)).sortWithinPartitions(*order)
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text")
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("bits", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])

    def blocks(batches):
        turn_to("tokens")
        words = shared_tokenizer(tokenizer_path, by_words)
        kind, width = words.kind, words.kind.itemsize
        end = np.array([END_ID], kind).tobytes()
        number, shard, ids, body, held = 0, 0, [], [], 0

        def block():
            flat = np.frombuffer(b"".join(body), kind)
            offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in body])]).tolist()
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [number], "bits": [bits], "doc_ids": [list(ids)], "offsets": [offsets], "payload": [pack(flat, bits)]}, schema=schema)

        for b in batches:
            shard, doc_ids = b.column(0)[0].as_py() if b.num_rows else shard, b.column(1).to_pylist()
            raw, off = utf8(b.column(2))
            at = 0
            while at < b.num_rows:  # slices of about 2 MB keep the arrays small
                to = max(at + 1, int(np.searchsorted(off, off[at] + (2 << 20), "right")) - 1)
                for i, x in enumerate(words.encode(raw[off[at] : off[to]], off[at : to + 1] - off[at]), at):
                    ids.append(doc_ids[i])
                    body.append(x + end)
                    held += len(x) // width + 1
                    if held >= _BLOCK_IDS:
                        yield block()
                        number, ids, body, held = number + 1, [], [], 0
                at = to
        if ids:
            yield block()

    return Table(ordered.mapInArrow(blocks, _BLOCKS), "packed", "zstd")


def read_packed(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks alone.

    Where each block starts comes from a running sum over its shard's blocks after one over the shards, so no task sees
    more than a shard's block headers.
    """
    heads = blocks.select("shard", "block", F.element_at("offsets", -1).alias("held"))
    shards = heads.groupBy("shard").agg(F.sum("held").alias("held"))
    before = shards.select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("base"))
    placed = heads.join(F.broadcast(before), "shard").select("shard", "block", (F.col("base") + F.sum("held").over(Window.partitionBy("shard").orderBy("block")) - F.col("held")).alias("first"))
    few = blocks.count() <= BROADCAST_IDS  # a row a block; beyond that the payloads move by a shuffle
    rows = blocks.join(F.broadcast(placed) if few else placed, ["shard", "block"]).select("first", "bits", "doc_ids", "offsets", "payload")

    def documents(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for first, bits, ids, offsets, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat = unpack(payload, bits, 0, offsets[-1]).astype("<u4")
                crc = [zlib.crc32(flat[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                off = np.array(offsets)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document: only blocks whose doc_ids hold it are read, and only its bits are unpacked."""
    found = spark.read.parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).collect()
    return [unpack(bytes(r.payload), r.bits, r.offsets[i], r.offsets[i + 1]) for r in sorted(found, key=lambda r: (r.shard, r.block)) for i, d in enumerate(r.doc_ids) if d == doc_id]


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
