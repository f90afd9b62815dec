"""Hashes counted over the whole corpus without a row for each hash.

Documents go to blocks of about equal bytes, in order of doc_id. A block sends,
for each of a number of prefixes, one array of its distinct hashes; a prefix
meets at most one copy of a hash from each block, however often it occurs, so
a hot passage costs no more than any other. What comes back to a block are the
numbers of those hashes which other blocks have too.

Blocks and prefixes both grow with the input, each with a task of its own, so
no task does. Only prefixes that a block has are sent: however many there are,
there are never more rows than hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

NO_ID = -(1 << 63)
SENT = "prefix int, block long, hashes binary"
MARKS = "block long, prefix int, marks binary"
#: Bounds in a plan, bytes of text that weigh as much as a row, and pieces that a doc_id may be cut into.
RANGES, WEIGHED, PIECES = 1024, 4096, 1 << 24
MANY, MOST_BYTES = 20_000, 256 << 20


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below doc_id, looked up in two levels."""
    if not bounds:
        return F.lit(0)
    wide = math.isqrt(len(bounds)) + 1
    groups = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first = F.size(F.filter(lit([g[0] for g in groups]), lambda x: x <= doc_id)) - 1
    inside = F.size(F.filter(F.get(F.array(*[lit(g) for g in groups]), first), lambda x: x <= doc_id))
    return F.when(first < 0, F.lit(0)).otherwise(first * wide + inside).cast("long")


def with_blocks(docs: DataFrame, block_bytes: int, min_blocks: int = 16) -> tuple[DataFrame, int]:
    """(doc_id, text, block) with a null doc_id as the smallest, and the number of blocks.

    A block has ``block_bytes``, and of a large input so much more that there
    are no more than ``MANY`` blocks, up to ``MOST_BYTES``.
    Bounds are quantiles of doc_id, counted once for each ``WEIGHED`` bytes.
    There are ``RANGES`` of them at most, cut evenly by doc_id into as many
    blocks as the bytes need. A doc_id with more than a block of text is dealt to
    blocks of its own by the hash of the text.
    """
    size = F.octet_length(text_of(F.col("text")))
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    sized = docs.select("doc_id", size.cast("long").alias("size"))
    weighed = sized.select("doc_id", F.posexplode(F.array_repeat("size", F.ceil((F.col("size") + 1) / WEIGHED).cast("int"))).alias("k", "size"))
    at = [k / RANGES for k in range(1, RANGES)]
    total, low, high, found = weighed.agg(
        F.sum(F.when(F.col("k") == 0, F.col("size"))), F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))), F.max("doc_id"), F.percentile_approx("doc_id", at, 20 * RANGES)
    ).first()
    block_bytes = max(block_bytes, min(MOST_BYTES, (total or 0) // MANY))
    n = max(min_blocks, math.ceil((total or 0) / block_bytes))
    used = min(n, RANGES)
    bounds = sorted({found[k * RANGES // used - 1] for k in range(1, used)}) if found else []
    each = -(-n // RANGES)
    block = range_of(F.col("doc_id"), bounds)
    if each > 1 and bounds:
        edge = lambda xs: F.get(F.array(*[F.lit(x).cast("double") for x in xs]), block.cast("int"))
        first, end = edge([low, *bounds]), edge([*bounds, high + 1])
        part = F.floor((F.col("doc_id") - first) / F.greatest(end - first, F.lit(1.0)) * each)
        block = block * each + F.greatest(F.lit(0), F.least(part, F.lit(each - 1))).cast("long")
    blocked = docs.withColumn("block", block * PIECES)
    heavy = written(sized.groupBy("doc_id").agg(F.sum("size").alias("_ik_bytes")).where(F.col("_ik_bytes") > block_bytes), "heavy")
    if not heavy.isEmpty():
        # The upper 31 bits of the hash, as a share of the pieces.
        share = F.shiftrightunsigned(F.xxhash64("text"), 33) / (1 << 31)
        piece = F.floor(share * F.ceil(F.col("_ik_bytes") / block_bytes)).cast("long")
        blocked = blocked.join(heavy.withColumnRenamed("doc_id", "_ik_id"), F.col("doc_id") == F.col("_ik_id"), "left").select(
            "doc_id", "text", (F.col("block") + F.coalesce(piece, F.lit(0))).alias("block")
        )
    return blocked, n


def in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block by doc_id; those of one doc_id by text. Null texts are empty."""
    return frame.assign(text=frame["text"].fillna("")).sort_values(["doc_id", "text"], kind="stable", ignore_index=True)


def distinct(hashes: np.ndarray, prefixes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of the distinct hashes, by prefix and then hash; where each prefix begins; the places that repeat one before."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.ones(len(order), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    places, again = order[first], order[~first]
    own = prefixes[places]
    places = places[np.argsort(own, kind="stable")]
    return places, np.searchsorted(prefixes[places], np.arange(n + 1)), again


def sent(hashes: np.ndarray, places: np.ndarray, begins: np.ndarray, block: int) -> pd.DataFrame:
    """The rows that a block sends: one for each prefix that it has."""
    full = np.flatnonzero(np.diff(begins))
    return pd.DataFrame({
        "prefix": full.astype("int32"), "block": np.int64(block),
        "hashes": [hashes[places[begins[p] : begins[p + 1]]].tobytes() for p in full],
    })


def met_elsewhere(frame: pd.DataFrame, keep_first: bool) -> pd.DataFrame:
    """(block, prefix, marks) of the rows of one prefix: numbers of the sent hashes that another block has too.

    With ``keep_first`` the block that is first in order isn't told.
    """
    if not len(frame):
        return pd.DataFrame(columns=["block", "prefix", "marks"])
    frame = frame.sort_values("block", ignore_index=True)
    parts = [np.frombuffer(b, np.uint64) for b in frame["hashes"]]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    if not keep_first:
        hit[:-1] |= same
    marked = np.zeros(len(order), bool)
    marked[order[hit]] = True
    out = []
    for k, block in enumerate(frame["block"]):
        own = np.flatnonzero(marked[begins[k] : begins[k + 1]])
        if len(own):
            out.append((block, frame["prefix"][0], own.astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["block", "prefix", "marks"])


def met(rows: DataFrame, keep_first: bool, tasks: int) -> DataFrame:
    """What ``met_elsewhere`` tells of all prefixes."""
    return rows.repartition(tasks, "prefix").groupBy("prefix").applyInPandas(lambda frame: met_elsewhere(frame, keep_first), MARKS)


def marked_places(marks: pd.DataFrame, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first places of the hashes that came back."""
    found = [places[begins[int(p)] + np.frombuffer(m, np.uint32)] for p, m in zip(marks["prefix"], marks["marks"], strict=True)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places a span of ``width`` from one of the starts covers."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, starts + width, 1)
    return np.cumsum(steps[:-1]) > 0
