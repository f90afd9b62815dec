"""Dual-sorted wavelet trees over posting lists, in numpy.

The postings of all terms stand one list after the other, each list by falling
impact: that is the root. A level splits every node by the next bit of the
document number, from the highest, and keeps the order inside each half. So the
part of a list that lies in a node is one range of it, its first entry has the
largest impact there, and the nodes of the last level are the documents.
"""

from __future__ import annotations

import numpy as np

#: Nodes that are taken from the queue and split together.
BEAM = 256


def bits_for(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def planes(docs: np.ndarray, n_bits: int) -> list[bytes]:
    """The bits of each level, for the document numbers of the root."""
    out, docs = [], docs.astype(np.uint16)
    for level in range(n_bits):
        out.append(np.packbits((docs >> np.uint16(n_bits - 1 - level)) & np.uint16(1), bitorder="little").tobytes())
        docs = docs[np.argsort(docs >> np.uint16(n_bits - 1 - level), kind="stable")]
    return out


class Cut:
    """The part of a stored tree that belongs to some lists: their ranges at the root, side by side.

    ``ones`` counts the set bits before each place of a level, ``impact`` has the
    impacts in the order of each level, the documents' included.
    """

    def __init__(self, stored: list[bytes], size: int, impacts: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        lengths = ends - begins
        self.lists = np.concatenate([[0], np.cumsum(lengths)])
        self.n, self.n_bits = int(self.lists[-1]), len(stored)
        place = np.repeat(begins - self.lists[:-1], lengths) + np.arange(self.n)
        impact = impacts[place]
        node, starts = np.zeros(self.n, np.int32), np.array([0, size])
        self.ones, self.impact = np.zeros((self.n_bits, self.n + 1), np.int32), np.zeros((self.n_bits + 1, self.n), np.int32)
        for level, plane in enumerate(stored):
            bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=size, bitorder="little")
            before = np.zeros(size + 1, np.int32)
            np.cumsum(bits, out=before[1:])
            own = bits[place].astype(np.int32)
            np.cumsum(own, out=self.ones[level, 1:])
            self.impact[level] = impact
            # Where each half of each node begins on the next level.
            halves = np.stack([starts[:-1], starts[1:] - (before[starts[1:]] - before[starts[:-1]])], axis=1).reshape(-1)
            ahead = before[place] - before[starts[node]]
            place = np.where(own == 1, ahead, place - starts[node] - ahead)
            node = 2 * node + own
            place += halves[node]
            starts = np.concatenate([halves, [size]])
            order = np.argsort(node.astype(np.uint16), kind="stable")
            place, node, impact = place[order], node[order], impact[order]
        self.impact[self.n_bits] = impact

    def top(self, lists: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best that reach ``least``, and of all that equal the last of them.

        Best first: open nodes wait with an upper bound, the weighted sum of the
        first impact of each list in them; at a document it is the score.
        """
        ones, impact, n = self.ones.reshape(-1), self.impact.reshape(-1), self.n
        low, high = self.lists[lists][None], self.lists[lists + 1][None]
        level, start, end, name = (np.array([x]) for x in (0, 0, n, 0))
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), max(least, 1)
        if not n or not len(lists):
            return docs, scores
        bound = np.where(low < high, weights * impact[np.minimum(low, n - 1)], 0).sum(axis=1)
        while True:
            alive = bound >= least
            if not alive.all():
                level, start, end, name, low, high, bound = (x[alive] for x in (level, start, end, name, low, high, bound))
            if not len(bound):
                return docs, scores
            if len(bound) > BEAM:
                order = np.argpartition(bound, len(bound) - BEAM)
                rest, best = order[:-BEAM], order[-BEAM:]
            else:
                rest, best = np.zeros(0, np.int64), np.arange(len(bound))
            leaf = level[best] == self.n_bits
            if leaf.any():
                docs, scores = np.concatenate([docs, name[best[leaf]]]), np.concatenate([scores, bound[best[leaf]]])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    docs, scores = docs[scores >= least], scores[scores >= least]
            split = best[~leaf]
            a, s, e = level[split] * (n + 1), start[split], end[split]
            base = ones[a + s]
            middle = e - (ones[a + e] - base)
            one_low, one_high = (ones[a[:, None] + x[split]] - base[:, None] for x in (low, high))
            new_low = np.concatenate([low[split] - one_low, middle[:, None] + one_low])
            new_high = np.concatenate([high[split] - one_high, middle[:, None] + one_high])
            below = np.concatenate([level[split]] * 2) + 1
            first = impact[below[:, None] * n + np.minimum(new_low, n - 1)]
            new_bound = np.where(new_low < new_high, first * weights, 0).sum(axis=1)
            join = lambda old, new: np.concatenate([old[rest], new])  # noqa: B023, E731
            level, start, end = join(level, below), join(start, np.concatenate([s, middle])), join(end, np.concatenate([middle, e]))
            name, bound = join(name, np.concatenate([2 * name[split], 2 * name[split] + 1])), join(bound, new_bound)
            low, high = join(low, new_low), join(high, new_high)
