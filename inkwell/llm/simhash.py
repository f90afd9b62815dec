"""SimHash near-duplicates by a positional byte index with count filtering.

A fingerprint has eight positional bytes. Fingerprints that differ in at most
``BITS`` bits differ in as many bytes at most, so at least ``SHARED`` = 5 of the
eight (position, byte) entries of such a pair are equal: the guaranteed minimum.
Lists of single entries hold a 256th of all fingerprints, and tallying them pair
by pair would be quadratic. So the lists are intersected before they are
tallied: a list of the index is that of five entries together, each fingerprint
stands in 56 of them, and a pair meets in one exactly if its tally of equal
bytes reaches the minimum. Random fingerprints meet there once in 2**40.

What one list holds agrees in 40 bits, so a list has no more than 2**24
different fingerprints however many rows there are. Its pairs are verified by
their unequal bits. Lists of up to ``PAIRED`` fingerprints compare all pairs;
longer ones look up all 2,324 values within reach of each fingerprint in a table
of the 24 open bits, so the work of a crowd is in proportion to its fingerprints
and nothing is cut. A list reports each linked fingerprint once, with the
smallest one of its own component, never all pairs.

Defined results: rows with equal fingerprints are linked, whatever their ids;
null, empty and blank texts have fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle; a null doc_id counts as the
smallest id and makes its component's id null; repeated rows give a row each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .hashing import LOWER
from .near_dedup import components

BYTES, BITS = 8, 3
SHARED = BYTES - BITS
#: Fingerprints of a list whose pairs are all compared, and shingles that are counted at once.
PAIRED, SLICE = 256, 1 << 16
#: Fingerprints whose entries one task makes.
TASK_ROWS = 1 << 15
NO_ID = -(1 << 63)
SEED = 42
#: The three open bytes of each list.
OPEN = list(combinations(range(BYTES), BITS))


def byte_mask(positions) -> int:
    return sum(0xFF << 8 * p for p in positions)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Bits that are set in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, SLICE):
        spans = [flat[a:b] for a, b in zip(starts[k : k + SLICE], ends[k : k + SLICE], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(seed)), np.uint64, len(spans))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [signed(fingerprint(t, width)) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": np.array(values, np.int64)})

    return run


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``labels`` (the least place of each) over the links a - b, in place."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def near_masks() -> np.ndarray:
    """All values of 24 bits with one to three bits."""
    return np.array([sum(1 << b for b in bits) for k in range(1, BITS + 1) for bits in combinations(range(8 * BITS), k)], np.uint32)


def linked_in_crowd(values: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """The least place that each of the distinct fingerprints of one list reaches, by a table of its open bits."""
    open_bits = np.zeros(len(values), np.uint32)
    for k, p in enumerate(positions):
        open_bits |= ((values >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.uint32) << np.uint32(8 * k)
    table = np.full(1 << 8 * BITS, -1, np.int32)
    table[open_bits] = np.arange(len(values), dtype=np.int32)
    labels = np.arange(len(values))
    for mask in near_masks():
        at = table[open_bits ^ mask]
        found = np.flatnonzero(at >= 0)
        if len(found):
            merged(labels, found, at[found])
    return labels


def linked_in_lists(lists: list[np.ndarray], positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lists that are linked to a smaller one, and the smallest of their component in the list."""
    sizes = np.array([len(x) for x in lists])
    few, out = np.flatnonzero(sizes <= PAIRED), []
    if len(few):
        flat = np.concatenate([lists[k] for k in few])
        ends = np.repeat(np.cumsum(sizes[few]), sizes[few])
        labels, at, step = np.arange(len(flat)), np.arange(len(flat)), 1
        while len(at := at[at + step < ends[at]]):
            near = at[np.bitwise_count(flat[at] ^ flat[at + step]) <= BITS]
            merged(labels, near, near + step)
            step += 1
        out.append((flat, labels))
    for k in np.flatnonzero(sizes > PAIRED):
        out.append((lists[k], linked_in_crowd(lists[k], OPEN[positions[k]])))
    pick = [(flat[moved], flat[labels[moved]]) for flat, labels in out if len(moved := np.flatnonzero(labels != np.arange(len(flat))))]
    return tuple(np.concatenate(x) for x in zip(*pick, strict=True)) if pick else (np.zeros(0, np.uint64),) * 2


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        lists = [np.sort(np.asarray(x, np.int64).view(np.uint64)) for x in frame["fps"]]
        a, b = linked_in_lists(lists, frame["list"].to_numpy())
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()


def index_entries(fp: Column) -> Column:
    """(list, key): which five positions, and their bytes, for each of the 56 lists that a fingerprint stands in."""
    every = byte_mask(range(BYTES))
    return F.array(*[
        F.struct(F.lit(k).alias("list"), fp.bitwiseAND(F.lit(signed(every ^ byte_mask(p)))).alias("key")) for k, p in enumerate(OPEN)
    ])


def simhash_components(distinct: DataFrame) -> DataFrame:
    """(node, component) of the linked ones of a table of different fingerprints (fp)."""
    # Small rows that grow 56 times: dealt first, so that no task makes more than its share.
    distinct = distinct.repartition(max(8, -(-distinct.count() // TASK_ROWS)))
    entries = distinct.select("fp", F.explode(index_entries(F.col("fp"))).alias("e")).select("e.list", "e.key", "fp")
    lists = entries.groupBy("list", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return components(lists.select("list", "fps").mapInPandas(_links, "a long, b long"))


def simhash_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint, component_id (the smallest doc_id that links reach)."""
    slim = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    signed_docs = written(slim.mapInPandas(_fingerprints(width), "doc_id long, fp long"), "fingerprints")
    firsts = written(signed_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    joined = simhash_components(firsts.select("fp"))
    owned = firsts.join(joined, firsts["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    owned = written(owned, "owned")
    smallest = owned.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = written(owned.join(smallest, "component").select(F.col("fp").alias("_ik_fp"), "component_id"), "classes")
    discard(firsts, owned)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = signed_docs.join(classes, F.col("fp") == F.col("_ik_fp"))
    return out.select(known("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), known("component_id"))
