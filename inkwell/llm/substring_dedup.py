"""Substring dedup: token windows whose sequence stands earlier go.

Rabin-Karp hashes of every window of ``width`` words are counted in Spark (see
``blocks``); a window whose hash has an earlier place (smaller doc_id, or the
same document and an earlier start) is a repeat, and repeats merge into maximal
removal intervals. Hashes have 64 bits beside an independent prefix, whose
number grows with the input; they are not compared word by word, and at 100 TB
about one window in all is expected to be taken for a repeat by chance.

Defined results: null and blank texts have no words and keep the empty string;
texts shorter than a window lose nothing; rows of one doc_id stand in order of
their text (of its hash first, where they are more than a block); a null doc_id
comes first; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .hashing import batches, hashed_words, mix, windows_hash

WIDTH = 20
BLOCK_BYTES = 4 << 20
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,end:long>>, kept_text string"


class _Windows:
    """The windows of a block's documents, in order."""

    def __init__(self, frame: pd.DataFrame, width: int, prefixes: int) -> None:
        self.frame = B.in_order(frame)
        self.texts = [t.encode() for t in self.frame["text"]]
        hashes, other, starts, counts = [], [], [], []
        total = 0
        for part in batches(self.texts):
            words, begins = hashed_words(self.texts[part])
            counts.append(np.diff(begins))
            rolled = windows_hash(words, width)
            inside = np.zeros(len(rolled), bool)
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                inside[a : max(a, b - width + 1)] = True
            hashes.append(rolled[inside])
            other.append((windows_hash(mix(words), width)[inside] % np.uint64(prefixes)).astype(np.int32))
            starts.append(np.flatnonzero(inside) + total)
            total += len(words)
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.hashes, self.prefixes, self.starts = cat(hashes, np.uint64), cat(other, np.int32), cat(starts, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(cat(counts, np.int64))])
        self.places, self.bounds, self.again = B.distinct(self.hashes, self.prefixes, prefixes)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, spans (maximal, in words) and kept_text."""
    blocked, n_blocks = B.with_blocks(docs, block_bytes)
    prefixes = math.ceil(n_blocks * 4 / 3)  # hashes are that much more than text

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        w = _Windows(frame, width, prefixes)
        return B.sent(w.hashes, w.places, w.bounds, int(frame["block"].iloc[0]))

    def finish(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
        w = _Windows(frame, width, prefixes)
        repeats = np.concatenate([w.again, B.marked_places(marks, w.places, w.bounds)])
        gone = B.covered(w.starts[repeats], width, int(w.begins[-1]))
        out = []
        for doc_id, text, a, b in zip(w.frame["doc_id"], w.texts, w.begins[:-1].tolist(), w.begins[1:].tolist(), strict=True):
            words, own = text.split(), gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).reshape(-1, 2)
            kept, at = [], 0
            for first, end in edges.tolist():
                kept += words[at:first]
                at = end
            kept += words[at:]
            out.append((doc_id, b - a, int(own.sum()), [{"first": x, "end": y} for x, y in edges.tolist()], b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    by_block = blocked.repartition(n_blocks, "block").groupBy("block")
    marks = B.met(by_block.applyInPandas(send, B.SENT), True, prefixes)
    found = by_block.cogroup(marks.repartition(n_blocks, "block").groupBy("block")).applyInPandas(finish, RESULT)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != B.NO_ID, F.col("doc_id")))


def substring_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
