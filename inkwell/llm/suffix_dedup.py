"""Suffix-array dedup: bytes of strings that stand elsewhere too go, all copies.

A string of ``width`` bytes is found by its anchor, the gram of ``width / 2``
bytes in it that has the smallest hash (the leftmost of equal ones): equal
strings have equal anchors at equal places, so only strings whose anchor occurs
twice in the corpus can repeat. Those with one anchor and the same ``EDGE`` bytes
on both sides of it meet in one task. There, the bytes from the anchor on, and
those before it backwards, are sorted by deep-shallow sorting: multikey
quicksort to a shallow depth, blind tries for the long common prefixes that
remain. Two strings at d bytes before their anchors are equal if the neighbours
in between share ``width - d`` bytes in the one order and d in the other, which
running counts over the sorted order tell for all strings at once. Strings that
don't hold ``EDGE`` bytes on a side of their anchor are counted by their hashes.

Every document that holds a passage has the passage's anchors, but its own bytes
around the passage, so the bytes on both sides deal a hot anchor to many tasks;
what is the same on both sides comes once from each block.

Defined results: a null text counts as empty; texts shorter than ``width`` lose
nothing; matches don't cross documents, overlaps count, strings are judged on
the input; rows of one doc_id are documents of their own; a null doc_id stays
null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .hashing import BASE, INVERSE, batches, mix, powers
from .suffix_sort import deep_shallow, neighbours_share

WIDTH = 200
BLOCK_BYTES = 3 << 20
PLACES = np.uint64((1 << 28) - 1)
#: Bytes on each side of an anchor by which its strings are dealt.
EDGE = 8
AROUND = "prefix int, block long, keys binary, numbers binary, lows binary, highs binary, bytes binary, hashes binary"
FOUND = "block long, numbers binary, lows binary, highs binary, edge int, marks binary"
AROUND_COLUMNS = [c.split()[0] for c in AROUND.split(", ")]
FOUND_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary"


def anchors(buffer: np.ndarray, begins: list[int], ends: list[int], width: int) -> tuple[np.ndarray, ...]:
    """Key, anchor, first and last start of every run of strings with one anchor."""
    gram = width // 2
    n, span = len(buffer) - gram + 1, width - gram + 1
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(buffer) < width:
        return none
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(buffer * powers(BASE, len(buffer)), out=sums[1:])
    hashes = (sums[gram:] - sums[:n]) * powers(INVERSE, n)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    least = (hashes & ~PLACES) | np.arange(n, dtype=np.uint64)
    have = 1
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    valid = np.zeros(len(buffer), bool)
    for a, b in zip(begins, ends, strict=True):
        valid[a : max(a, b - width + 1)] = True
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    anchor = (least[starts] & PLACES).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return mix(hashes[anchor[first]]), anchor[first], starts[first], starts[last]


class _Runs:
    """The runs of a block's documents, in order."""

    def __init__(self, frame: pd.DataFrame, width: int, prefixes: int) -> None:
        self.frame, self.width, self.n_prefixes = B.in_order(frame), width, prefixes
        self.texts = [t.encode() for t in self.frame["text"]]
        parts, self.begins, total = [], [], 0
        for part in batches(self.texts):
            joined = b"".join(self.texts[part])
            begins = np.concatenate([[0], np.cumsum([len(t) for t in self.texts[part]])]).tolist()
            keys, *places = anchors(np.frombuffer(joined, np.uint8), begins[:-1], begins[1:], width)
            parts.append((keys, *[p + total for p in places]))
            self.begins += [b + total for b in begins[:-1]]
            total += len(joined)
        self.begins.append(total)
        self.keys, self.anchors, self.first, self.last = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.buffer = b"".join(self.texts)
        self.prefixes = (mix(self.keys) % np.uint64(prefixes)).astype(np.int32)
        self.places, self.bounds, self.again = B.distinct(self.keys, self.prefixes, prefixes)

    def surroundings(self, marks: pd.DataFrame) -> tuple[list[int], list[int]]:
        """Runs whose anchor occurs twice, one for each content; and the runs with a copy in this block."""
        hot = np.unique(np.concatenate([self.keys[self.again], self.keys[B.marked_places(marks, self.places, self.bounds)]]))
        seen: dict[tuple[int, bytes], int] = {}
        copies = set()
        for k in np.flatnonzero(np.isin(self.keys, hot)).tolist():
            a, b = int(self.first[k]), int(self.last[k])
            content = (int(self.anchors[k]) - a, self.buffer[a : b + self.width])
            one = seen.setdefault(content, k)
            if one != k:
                copies |= {one, k}
        return list(seen.values()), sorted(copies)


def window_hashes(buffer: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings of ``width`` bytes at these starts."""
    out = np.zeros(len(starts), np.uint64)
    padded = -(-width // 8) * 8
    windows = np.lib.stride_tricks.sliding_window_view(buffer, width) if len(starts) else None
    for k in range(0, len(starts), 1 << 14):
        some = starts[k : k + (1 << 14)]
        rows = np.zeros((len(some), padded), np.uint8)
        rows[:, :width] = windows[some]
        h = out[k : k + (1 << 14)]
        for column in np.ascontiguousarray(rows.view(np.uint64).T):
            h[:] = mix(h * BASE + column)
    return out


class _Edges:
    """The strings of some runs that have less than ``EDGE`` bytes on a side of their anchor, and their distinct hashes."""

    def __init__(self, runs: _Runs, numbers: list[int]) -> None:
        at, half = np.array(numbers, np.int64), runs.width - runs.width // 2
        anchor, low, high = runs.anchors[at], runs.anchors[at] - runs.last[at], runs.anchors[at] - runs.first[at]
        near = [d for d in range(half + 1) if d < EDGE or d > half - EDGE]
        self.starts = np.concatenate([np.zeros(0, np.int64), *[(anchor - d)[(low <= d) & (d <= high)] for d in near]])
        self.hashes = window_hashes(np.frombuffer(runs.buffer, np.uint8), self.starts, runs.width)
        prefixes = (mix(self.hashes ^ BASE) % np.uint64(runs.n_prefixes)).astype(np.int32)
        self.places, self.bounds, self.again = B.distinct(self.hashes, prefixes, runs.n_prefixes)

    def repeated(self, marks: pd.DataFrame) -> np.ndarray:
        """Starts of those that stand twice, here or elsewhere."""
        hot = np.concatenate([self.hashes[self.again], self.hashes[B.marked_places(marks, self.places, self.bounds)]])
        return self.starts[np.isin(self.hashes, hot)]


def _around(runs: _Runs, marks: pd.DataFrame, block: int) -> pd.DataFrame:
    numbers, _ = runs.surroundings(marks)
    half, gram = runs.width - runs.width // 2, runs.width // 2
    own = np.array(numbers, np.int64)
    low, high = np.maximum(EDGE, runs.anchors[own] - runs.last[own]), np.minimum(half - EDGE, runs.anchors[own] - runs.first[own])
    own, low, high = (x[low <= high] for x in (own, low, high))
    anchor, raw, eight = runs.anchors[own], np.frombuffer(runs.buffer, np.uint8), np.arange(EDGE)
    side = lambda at: np.ascontiguousarray(raw[at[:, None] + eight]).view(np.uint64).reshape(-1)
    keys = mix(mix(runs.keys[own] * BASE + side(anchor - EDGE)) * BASE + side(anchor + gram)) if len(own) else runs.keys[:0]
    prefixes = (mix(keys) % np.uint64(runs.n_prefixes)).astype(np.int32)
    order = np.argsort(prefixes, kind="stable")
    cuts = np.flatnonzero(np.diff(prefixes[order])) + 1
    out: list[tuple] = []
    for rows in np.split(order, cuts) if len(order) else []:
        spans = zip((anchor[rows] - high[rows]).tolist(), (anchor[rows] + runs.width - low[rows]).tolist(), strict=True)
        out.append((
            int(prefixes[rows[0]]), block, keys[rows].tobytes(), own[rows].astype(np.uint32).tobytes(), low[rows].astype(np.uint16).tobytes(),
            high[rows].astype(np.uint16).tobytes(), b"".join([runs.buffer[x:y] for x, y in spans]), None,
        ))
    edges = _Edges(runs, numbers)
    sent = B.sent(edges.hashes, edges.places, edges.bounds, block)
    out += [(prefix, block, *[None] * 5, hashes) for prefix, hashes in zip(sent["prefix"], sent["hashes"], strict=True)]
    return pd.DataFrame(out, columns=AROUND_COLUMNS)


def _repeats(width: int):
    """For the runs of a prefix: which strings, by distance from the anchor, occur twice, and which hashes of edges."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        edges = B.met_elsewhere(frame[frame["hashes"].notna()], False)
        told = edges.rename(columns={"prefix": "edge"}).reindex(columns=FOUND_COLUMNS)
        return pd.concat([runs_of(frame[frame["keys"].notna()]), told])

    def runs_of(frame: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=FOUND_COLUMNS)
        if not len(frame):
            return none
        frame = frame.sort_values("block", ignore_index=True)
        cat = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in frame[c]])
        keys, numbers = cat("keys", np.uint64), cat("numbers", np.uint32)
        low, high = cat("lows", np.uint16).astype(np.int64), cat("highs", np.uint16).astype(np.int64)
        owner = np.repeat(frame["block"].to_numpy(), [len(x) // 8 for x in frame["keys"]])
        raw = np.frombuffer(b"".join(frame["bytes"]), np.uint8)
        sizes = high - low + width
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        _, group, count = np.unique(keys, return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[group] > 1)
        keys, numbers, low, high, owner, begin = (x[some] for x in (keys, numbers, low, high, owner, begin))
        n, half = len(keys), width - width // 2
        if not n:
            return none
        ahead, behind = width - low, high
        place = np.arange(width)
        anchor = (begin + high)[:, None]
        after = np.where(place < ahead[:, None], raw[np.minimum(anchor + place, len(raw) - 1)], 0).astype(np.uint8)
        back = np.arange(half + 24)
        before = np.where(back < behind[:, None], raw[np.maximum(anchor - 1 - back, 0)], 0).astype(np.uint8)
        after = np.pad(after, ((0, 0), (0, 24)))
        forward = deep_shallow(keys, after, ahead, width // 2)
        backward = deep_shallow(keys, before, behind, 0)
        share_f = neighbours_share(keys, after, ahead, forward)
        share_b = neighbours_share(keys, before, behind, backward)
        twice = np.zeros((half + 3, n), bool)  # a row of False at either end
        class_f, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
        for d in range(half + 1):
            own = np.flatnonzero((low <= d) & (d <= high))
            if len(own) < 2:
                continue
            class_f[forward] = np.cumsum(share_f < width - d)
            if d:
                class_b[backward] = np.cumsum(share_b < d)
            else:
                class_b[:] = 0
            pairs = class_f[own] * (n + 1) + class_b[own]
            order = np.argsort(pairs, kind="stable")
            same = pairs[order][1:] == pairs[order][:-1]
            hit = np.zeros(len(own), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            twice[d + 1, own] = hit
        step = np.diff(twice.astype(np.int8), axis=0).T
        which, low_d = np.nonzero(step == 1)
        _, high_d = np.nonzero(step == -1)
        rows = pd.DataFrame({"block": owner[which], "number": numbers[which], "low": low_d, "high": high_d - 1})
        return pd.DataFrame(
            [(b, g["number"].to_numpy(np.uint32).tobytes(), g["low"].to_numpy(np.uint16).tobytes(), g["high"].to_numpy(np.uint16).tobytes()) for b, g in rows.groupby("block")],
            columns=["block", "numbers", "lows", "highs"],
        ).reindex(columns=FOUND_COLUMNS)

    return run


def dedup_repeated_bytes(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, spans (maximal, in bytes) and the kept bytes."""
    blocked, n_blocks = B.with_blocks(docs, block_bytes)
    prefixes = -(-n_blocks // 4)  # what is sent is a fraction of the text

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        r = _Runs(frame, width, prefixes)
        return B.sent(r.keys, r.places, r.bounds, int(frame["block"].iloc[0]))

    def around(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        return _around(_Runs(frame, width, prefixes), marks, int(frame["block"].iloc[0])) if len(frame) else pd.DataFrame(columns=AROUND_COLUMNS)

    def finish(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
        marks, found = told[told["prefix"].notna()], told[told["numbers"].notna()]
        edges = told[told["edge"].notna()][["edge", "marks"]].rename(columns={"edge": "prefix"})
        r = _Runs(frame, width, prefixes)
        numbers, copies = r.surroundings(marks)
        at_edge = _Edges(r, numbers).repeated(edges)
        # Ranges of starts: whole runs with a copy in the block, what was found elsewhere, and the edges.
        number = np.concatenate([[], *[np.frombuffer(x, np.uint32) for x in found["numbers"]]]).astype(np.int64)
        low = np.concatenate([[], *[np.frombuffer(x, np.uint16) for x in found["lows"]]]).astype(np.int64)
        high = np.concatenate([[], *[np.frombuffer(x, np.uint16) for x in found["highs"]]]).astype(np.int64)
        whole = np.array(copies, np.int64)
        first = np.concatenate([r.first[whole], r.anchors[number] - high, at_edge])
        last = np.concatenate([r.last[whole], r.anchors[number] - low, at_edge])
        steps = np.zeros(r.begins[-1] + 1, np.int32)
        np.add.at(steps, first, 1)
        np.subtract.at(steps, last + width, 1)
        gone = np.cumsum(steps[:-1], dtype=np.int32) > 0
        out = []
        for doc_id, text, a, b in zip(r.frame["doc_id"], r.texts, r.begins[:-1], r.begins[1:], strict=True):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).reshape(-1, 2).tolist()
            kept, at = [], 0
            for x, y in edges:
                kept.append(text[at:x])
                at = y
            out.append((doc_id, b - a, int(own.sum()), [{"first": x, "end": y} for x, y in edges], b"".join([*kept, text[at:]])))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    by_block = blocked.repartition(n_blocks, "block").groupBy("block")
    marks = B.met(by_block.applyInPandas(send, B.SENT), False, n_blocks)
    near = by_block.cogroup(marks.repartition(n_blocks, "block").groupBy("block")).applyInPandas(around, AROUND)
    found = near.repartition(n_blocks, "prefix").groupBy("prefix").applyInPandas(_repeats(width), FOUND)
    told = marks.unionByName(found, allowMissingColumns=True)
    out = by_block.cogroup(told.repartition(n_blocks, "block").groupBy("block")).applyInPandas(finish, RESULT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != B.NO_ID, F.col("doc_id")))


def removed_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes."""
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
