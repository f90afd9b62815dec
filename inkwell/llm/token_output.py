"""Token ids in a bit-packed block format.

A block holds whole documents in ascending doc_id order: a header, the doc ids,
the offset of each document among the block's ids, and the ids, each in the
fewest bits that hold the vocabulary, so the k-th id of a block stands at bit
k * bits: blocks unpack as one numpy expression and any document or id is read
without the others. Blocks are rows of a Parquet table that Spark writes and
reads (shard, block, first_doc, n_docs, n_ids, data), so any store will do.

Defined results: a null text counts as empty, and an empty one gives the end id
alone; a document longer than a block is a block of its own; rows of one doc_id
stand in order of their text's hash; a null doc_id comes first; extra columns
are ignored; an empty table gives no blocks.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import given_back

MAGIC = b"IKT1"
HEADER = struct.Struct("<4sHxxIQ")
BLOCKS = "shard int, block int, first_doc long, n_docs int, n_ids long, data binary"
ROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary()),
])
NO_ID = -(1 << 63)
END_ID = 1
BLOCK_IDS = 1 << 16
#: Chunks of a generation; a worker remembers two, and each chunk takes some 150 bytes.
REMEMBERED = 250_000
#: Bytes of text that are cut into chunks at once, with some 28 bytes of memory for each meanwhile; a longer text is cut alone.
SLICE_BYTES = 1 << 20
#: Bytes of text that one task encodes, and what a row weighs besides its text.
TASK_BYTES, ROW_BYTES = 16 << 20, 64


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, lowest bit first."""
    ids = np.asarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n - 1 of packed data; only their bytes are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    at, skip = divmod(first * bits, 8)
    raw = np.frombuffer(data, np.uint8, -(-(n * bits + skip) // 8), at)
    each = np.unpackbits(raw, bitorder="little")[skip : skip + n * bits].reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def make_block(doc_ids: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    offsets = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    head = HEADER.pack(MAGIC, bits, len(ids), int(offsets[-1]))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), offsets.tobytes(), pack(np.concatenate(ids), bits)])


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, int, memoryview]:
    """Doc ids, offsets, bits and the packed part of a block."""
    magic, bits, n_docs, _ = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEADER.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    offsets = np.frombuffer(data, "<u8", n_docs + 1, at + 8 * n_docs).astype(np.int64)
    return doc_ids, offsets, bits, memoryview(data)[at + 8 * n_docs + 8 * (n_docs + 1) :]


#: A normalizer and splitter under which a run of letters is one piece of its own.
LETTER_RUNS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: ASCII marks but ">", with which the added tokens end; and as a character class.
MARKS = "!\"#$%&'()*+,-./:;<=?@[\\]^_`{|}~"
CLOSING = r"!-/:-=?@\[-`{-~"
#: Letters of Latin-1, as a character class: each is one code point under every normal form that composes.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def letter_runs(tokenizer) -> bool:
    """Whether the tokenizer lower-cases and gives each run of letters an end-of-word id, the last of its ids."""
    form = json.loads(tokenizer.to_str())
    steps = (form["normalizer"] or {}).get("normalizers", [])
    cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == LETTER_RUNS["normalizer"] and [x["type"] for x in cuts] == LETTER_RUNS["pre_tokenizer"]
        and all(x["content"].endswith(">") for x in form["added_tokens"]) and cuts[0]["pattern"] == {"Regex": LETTER_RUNS["pattern"]} and form["model"].get("end_of_word_suffix") == "</w>"
    )


class Encoder:
    """Ids of whole texts.

    Where ``letter_runs`` holds, the tokenizer never looks across white space:
    the ids of a text are those of its chunks in order, and each is encoded once
    and remembered. Only ASCII white space cuts: all else, special tokens
    included, stays inside a chunk. A chunk that ends in a letter or digit and
    marks after it is looked up as those two parts, and words of Latin-1 letters
    go to the same model in lower case without the normalizer and the pattern,
    which leave them as they are. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.words = None
        if letter_runs(self.tokenizer):
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def keep(self, chunks: list[str], ids: np.ndarray, cut: np.ndarray) -> None:
        raw = ids.tobytes()
        at = (4 * cut).tolist()
        self.known.update(zip(chunks, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))

    def learn_words(self, words: list[str]) -> None:
        """Encode words of Latin-1 letters in lower case: each ends at the first id that ends a word."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cut) == len(part):
                self.keep(part, ids, np.concatenate([[0], cut]))
            else:
                self.learn_any(part)

    def learn_any(self, chunks: list[str]) -> None:
        """Encode chunks of any kind: the offsets tell whose id each is."""
        for k in range(0, len(chunks), 4096):
            part = chunks[k : k + 4096]
            starts = np.zeros(len(part) + 1, np.int64)
            np.cumsum([len(t) + 1 for t in part], out=starts[1:])
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            first = np.array([a for a, _ in got.offsets], np.int64)
            self.keep(part, np.array(got.ids, "<u4"), np.searchsorted(first, starts))

    def look_up(self, pieces: pa.Array, words: pa.Array) -> list[bytes]:
        """The ids of distinct pieces; new ones are encoded, many in a call. What a generation didn't use is forgotten."""
        each = pieces.to_numpy(zero_copy_only=False).tolist()
        raw = list(map(self.known.get, each))
        new = [k for k, x in enumerate(raw) if x is None]
        for k in new:
            raw[k] = self.older.get(each[k])
        self.known.update((each[k], raw[k]) for k in new if raw[k] is not None)
        new = [k for k in new if raw[k] is None]
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {"": b""}
        word = words.to_numpy(zero_copy_only=False)
        self.learn_words([each[k] for k in new if word[k]])
        self.learn_any([each[k] for k in new if not word[k]])
        for k in new:
            raw[k] = self.known[each[k]]
        return raw

    def ids_of(self, chunks: pa.Array) -> pa.Array:
        """A list of ids for each of these distinct chunks."""
        cut = pc.match_substring_regex(chunks, f"[0-9{LETTERS}][{CLOSING}]+$")
        cores = pc.if_else(cut, pc.ascii_rtrim(chunks, MARKS), chunks)
        tails = pc.replace_with_mask(
            pc.utf8_slice_codeunits(chunks, 0, 0), cut, pc.replace_substring_regex(chunks.filter(cut), f"^.*[0-9{LETTERS}]", "")
        )
        cores = pc.if_else(pc.match_substring_regex(cores, f"^[{LETTERS}]+$"), pc.utf8_lower(cores), cores)
        pieces = pa.concat_arrays([cores, tails]).dictionary_encode()
        raw = self.look_up(pieces.dictionary, pc.match_substring_regex(pieces.dictionary, f"^[{LETTERS}]+$"))
        # Core and tail of each chunk in turn; two lists become one.
        turns = pieces.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.reshape(-1)
        both = id_lists(raw).take(pa.array(turns))
        return pa.LargeListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin; the end of the last follows."""
        if self.words is None:
            # Whole texts, with a bounded number of encodings held at once.
            every = [np.array(x.ids, "<u4") for k in range(0, len(texts), 256) for x in self.tokenizer.encode_batch_fast(texts[k : k + 256].to_pylist(), add_special_tokens=False)]
            starts = np.zeros(len(every) + 1, np.int64)
            np.cumsum([len(x) for x in every], out=starts[1:])
            return np.concatenate([np.zeros(0, "<u4"), *every]), starts
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.values.dictionary_encode()
        each = self.ids_of(coded.dictionary).take(coded.indices)
        return each.values.to_numpy(), each.offsets.to_numpy()[chunks.offsets.to_numpy()]


def id_lists(raw: list[bytes]) -> pa.Array:
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) >> 2, out=starts[1:])
    return pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(raw), "<u4")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker, whose memory serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes; a longer text is alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield at, end
        at = end


def encoded_blocks(path: str, end_id: int, vocabulary: int, block_ids: int):
    bits = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block, shard, docs, ids, total = encoder(path), 0, 0, [], [], 0
        end = np.array([end_id], "<u4")

        def full() -> pa.RecordBatch:
            row = (shard, block, docs[0], len(docs), total, make_block(docs, ids, bits))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ROW, strict=True)], schema=ROW)

        for batch in batches:
            texts = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            for a, b in slices(texts, SLICE_BYTES):
                got, starts = of.encode(texts.slice(a, b - a))
                for k, doc_id in enumerate(batch["doc_id"].slice(a, b - a).to_pylist()):
                    own = np.concatenate([got[starts[k] : starts[k + 1]], end])
                    if docs and total + len(own) > block_ids:
                        yield full()
                        block, docs, ids, total = block + 1, [], [], 0
                    shard = batch["shard"][0].as_py()
                    docs.append(doc_id)
                    ids.append(own)
                    total += len(own)
        if docs:
            yield full()

    return given_back(run)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, vocabulary: int | None = None, block_ids: int = BLOCK_IDS
) -> None:
    """Write the token table of ``docs`` to ``path``; the tokenizer file must be readable by executors."""
    if vocabulary is None:
        vocabulary = max(end_id + 1, encoder(tokenizer_path).tokenizer.get_vocab_size(with_added_tokens=True))
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES)).first()[0] or 0
    (
        docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("_ik_tie"))
        .repartitionByRange(max(8, -(-n_bytes // TASK_BYTES)), "doc_id", "_ik_tie").sortWithinPartitions("doc_id", "_ik_tie")
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
        .mapInArrow(encoded_blocks(tokenizer_path, end_id, vocabulary, block_ids), BLOCKS)
        .write.option("compression", "zstd").parquet(path)
    )


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for shard, block, data in zip(frame["shard"], frame["block"], frame["data"], strict=True):
            doc_ids, offsets, bits, packed = read_block(data)
            raw = unpack(packed, bits, 0, int(offsets[-1])).tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pd.DataFrame({
                "doc_id": doc_ids, "shard": np.int32(shard), "block": np.int32(block),
                "place": np.arange(len(doc_ids), dtype=np.int32), "n_tokens": np.diff(offsets), "ids_crc32": np.array(crc, np.int64),
            })


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of a token table: doc_id, start, n_tokens, ids_crc32, shard, block."""
    rows = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "data").mapInPandas(
        given_back(_decoded), "doc_id long, shard int, block int, place int, n_tokens long, ids_crc32 long"
    )
    # Sums of the shards, a row for each partition that was written; then those inside a shard.
    counts = spark.read.schema(BLOCKS).parquet(path).groupBy(F.col("shard").alias("_ik_shard")).agg(F.sum("n_ids").alias("_ik_n"))
    ahead = Window.orderBy("_ik_shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_ik_shard", F.coalesce(F.sum("_ik_n").over(ahead), F.lit(0)).alias("_ik_first"))
    inside = Window.partitionBy("shard").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ik_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(counts, rows["shard"] == counts["_ik_shard"]).select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("_ik_first") + F.col("_ik_start")).alias("start"),
        "n_tokens", "ids_crc32", "shard", "block",
    )
