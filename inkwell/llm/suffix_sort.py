"""Deep-shallow sorting of byte strings, and what sorted order tells about prefixes."""

from __future__ import annotations

import numpy as np


class BlindTrie:
    """A Patricia trie of byte strings: nodes know the byte to look at, not the bytes skipped.

    A string goes down blindly to some leaf; one comparison with that leaf
    gives the place where the string branches off.
    """

    def __init__(self, first: bytes) -> None:
        self.root: object = first

    @staticmethod
    def _at(s: bytes, k: int) -> int:
        return s[k] if k < len(s) else -1

    @staticmethod
    def shared(a: bytes, b: bytes) -> int:
        """Length of the common prefix."""
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def add(self, s: bytes) -> None:
        """Insert a string that isn't in the trie."""
        node = self.root
        while isinstance(node, tuple):
            k, children = node
            child = children.get(self._at(s, k))
            node = child if child is not None else next(iter(children.values()))
        depth, leaf = self.shared(s, node), node
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][self._at(s, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._at(s, depth)] = s
            return
        branch = (depth, {self._at(s, depth): s, self._at(leaf, depth): node})
        if above is None:
            self.root = branch
        else:
            above[1][self._at(s, above[0])] = branch

    def sorted(self) -> list[bytes]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def _words(rows: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes of each row as one number that sorts as they do."""
    return np.ascontiguousarray(rows[:, at : at + 8]).view(">u8").reshape(-1).astype(np.uint64)


def deep_shallow(keys: np.ndarray, rows: np.ndarray, lengths: np.ndarray, skip: int, shallow: int = 16) -> np.ndarray:
    """Order of zero-padded rows by key and then bytes; ``skip`` leading bytes are equal within a key.

    Multikey quicksort with characters of eight bytes orders to a depth of
    ``shallow``: each pass partitions the groups that are still equal by their
    next character and leaves the settled rows alone. Blind tries order the
    groups that are equal at that depth.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    tied = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    for at in range(skip, skip + shallow, 8):
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        places = np.flatnonzero(open_)
        group, mine = np.cumsum(~tied)[places], order[places]
        character = _words(rows[mine], at)
        by = np.lexsort((character, group))
        order[places], character = mine[by], character[by]
        tied[places[1:]] &= character[1:] == character[:-1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        members = order[a - 1 : b].tolist()
        same: dict[bytes, list[int]] = {}
        for m in members:
            same.setdefault(rows[m, : lengths[m]].tobytes(), []).append(m)
        if len(same) > 1:
            strings = iter(same)
            trie = BlindTrie(next(strings))
            for s in strings:
                trie.add(s)
            members = [m for s in trie.sorted() for m in same[s]]
        else:
            members = next(iter(same.values()))
        order[a - 1 : b] = members
    assert len(order) == n
    return order


def neighbours_share(keys: np.ndarray, rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in the order; 0 across keys."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 14):
        here, last = order[a : a + (1 << 14)], order[a - 1 : a - 1 + (1 << 14)]
        last = last[: len(here)]
        differ = rows[here] != rows[last]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        first = np.minimum(first, np.minimum(lengths[here], lengths[last]))
        out[a : a + len(here)] = np.where(keys[here] == keys[last], first, 0)
    return out
