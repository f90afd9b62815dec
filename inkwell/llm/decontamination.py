"""Benchmark decontamination: short items found inside long documents.

Items are partitioned by the size of their shingle set (powers of two), and each
partition has its own MinHash search: a bottom-k sketch of every item, its k
smallest hashes, and the least number of these that a document must hold. An
item of m shingles of which ``need`` must be in the document can miss m - need,
so of k = m - need + hits smallest hashes at least ``hits`` are found; ``hits``
grows with the partition, as more of them can be asked of larger items. So the
search loses no match, however long the document is; exact containment of the
word shingles then confirms.

Words are white-space separated with A-Z lower-cased; shingles take five words,
or all words of an item that has fewer. Defined results: null, empty and blank
items match nothing, as do such documents; a null doc_id or item_id is one like
any other and stays null in the matches; repeated items and documents give a
row each; extra columns are carried by ``remove_contaminated`` and ignored
otherwise; an empty table on either side gives no matches.

The benchmark goes to the tasks in blocks of about ``block_bytes`` of text,
dealt by hash, with one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back
from .hashing import LOWER, batches, hashed_words, windows_hash

SHINGLE = 5
CONTAINMENT = (4, 5)
BLOCK_BYTES = 32 << 20
MATCHES = "doc_id long, item_id long, n_shared long, n_shingles long"
MATCHED = ["doc_id", "item_id", "n_shared", "n_shingles"]


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def partition_of(m: int) -> int:
    """Sizes 1, 2-3, 4-7, 8-15 and so on."""
    return m.bit_length() - 1


def sketch_of(m: int, containment: tuple[int, int] = CONTAINMENT) -> tuple[int, int]:
    """How many of the smallest hashes of a set of m are kept, and how many of them a sufficient overlap holds at least."""
    need = -(-m * containment[0] // containment[1])
    hits = min(need, 1 + partition_of(m) // 2)
    return m - need + hits, hits


class ItemIndex:
    """Sketches of a block of items, by partition: sorted hashes and the items of each."""

    def __init__(self, items: list[tuple[int, str]], containment: tuple[int, int] = CONTAINMENT) -> None:
        self.containment, self.ids, self.sets, least = containment, [], [], []
        postings: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = (text or "").encode().translate(LOWER).split()
            if not words:
                continue
            width = min(SHINGLE, len(words))
            hashes = np.unique(windows_hash(hashed_words([b" ".join(words)])[0], width))
            kept, hits = sketch_of(len(hashes), containment)
            own = postings.setdefault((width, partition_of(len(hashes))), [])
            own += [(int(h), len(self.ids)) for h in hashes[:kept]]
            self.ids.append(item_id)
            self.sets.append(shingles(words, width))
            least.append(hits)
        self.least = np.array(least, np.int64)
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (width, _), pairs in postings.items():
            pairs.sort()
            self.partitions.setdefault(width, []).append((np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)))

    def candidates(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text, item) where the text holds enough of the item's sketch, in order."""
        words, begins = hashed_words(texts)
        found = []
        for width, partitions in self.partitions.items():
            hashes = windows_hash(words, width)
            text = np.repeat(np.arange(len(texts)), np.diff(begins))[: len(hashes)]
            inside = np.arange(len(hashes)) + width <= begins[text + 1]
            hashes, text = hashes[inside], text[inside]
            for keys, items in partitions:
                low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
                some = np.flatnonzero(high > low)
                # A row for each text and sketched hash that it holds, once however often.
                place = np.concatenate([np.arange(a, b) for a, b in zip(low[some], high[some], strict=True)]) if len(some) else some
                once = np.unique(np.repeat(text[some], (high - low)[some]) * len(keys) + place)
                pairs, n = np.unique(once // len(keys) * len(self.ids) + items[once % len(keys)], return_counts=True)
                found.append(pairs[n >= self.least[pairs % len(self.ids)]])
        return [divmod(p, len(self.ids)) for p in np.sort(np.concatenate(found)).tolist()] if found else []

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of every match."""
        found = []
        for part in batches(texts):
            last, own = (-1, -1), set()
            for t, i in self.candidates(texts[part]):
                width = next(iter(self.sets[i])).count(b" ") + 1
                if (t, width) != last:
                    last, own = (t, width), shingles(texts[part][t].split(), width)
                shared = len(self.sets[i] & own)
                if shared * self.containment[1] >= len(self.sets[i]) * self.containment[0]:
                    found.append((part.start + t, i, shared))
        return found


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks whose texts are about ``block_bytes``, dealt by hash."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    dealt = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"))
    for k in range(n):
        yield [tuple(r) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect()]


def _lowered(texts) -> list[bytes]:
    return [(t or "").encode().translate(LOWER) for t in texts]


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, n_shared, n_shingles, containment."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    found = []
    for items in item_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(items)

        def search(found: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value)
            for batch in found:
                rows = index.matches(_lowered(batch.column("text").to_pylist()))
                of = batch.column("doc_id").take(pa.array([t for t, _, _ in rows], pa.int64()))
                rest = [[index.ids[i] for _, i, _ in rows], [n for _, _, n in rows], [len(index.sets[i]) for _, i, _ in rows]]
                yield pa.RecordBatch.from_arrays([of, *[pa.array(x, pa.int64()) for x in rest]], MATCHED)

        found.append(slim.mapInArrow(given_back(search), MATCHES))
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, with all their columns and without a shuffle."""
    spark = docs.sparkSession
    for items in item_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(items)

        def keep(found: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value)
            for batch in found:
                texts = _lowered(batch.column(batch.schema.get_field_index("text")).to_pylist())
                clean = np.ones(len(texts), bool)
                clean[[t for t, _, _ in index.matches(texts)]] = False
                yield batch.filter(clean)

        docs = docs.mapInArrow(given_back(keep), docs.schema)
    return docs
