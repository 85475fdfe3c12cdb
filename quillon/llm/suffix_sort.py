"""Deep-shallow sorting of byte strings, with their common prefix lengths.

The shallow part is a multikey quicksort whose characters are words of 8 bytes, down to
``shallow`` bytes. Strings that agree so far are ordered by a blind trie: it holds only
branching depths and branching bytes, so that a string costs one comparison whatever the
length of its common prefix.
"""

from __future__ import annotations

import numpy as np

_END = -1
#: So few rows are sorted at once.
FEW = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _multikey_quicksort(words: np.ndarray) -> list[np.ndarray]:
    """Row numbers in order, as groups of rows that are equal in all words."""
    groups, todo, deep = [], [(np.arange(len(words)), 0)], words.shape[1]
    while todo:
        rows, d = todo.pop()
        if len(rows) == 0:
            continue
        if len(rows) == 1 or d == deep:
            groups.append(rows)
        elif len(rows) <= FEW:
            rows = rows[np.lexsort(words[rows, d:].T[::-1])]
            own = words[rows, d:]
            groups += np.split(rows, np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1)
        else:
            char = words[rows, d]
            pivot = np.sort(char[[0, len(char) // 2, -1]])[1]
            todo += [(rows[char > pivot], d), (rows[char == pivot], d + 1), (rows[char < pivot], d)]
    return groups


class BlindTrie:
    """Leaves are lists of equal strings' numbers; a node is (depth, {byte: child})."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while type(node) is tuple:
            depth, children = node
            char = s[depth] if depth < len(s) else _END
            path.append(node)
            node = children[char] if char in children else next(iter(children.values()))
        other = self.strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node.append(i)
            return
        own, its = s[shared] if shared < len(s) else _END, other[shared] if shared < len(other) else _END
        above = None
        for step in path:
            if step[0] >= shared:
                node = step
                break
            above = step
        if type(node) is tuple and node[0] == shared:
            node[1][own] = [i]
            return
        branch = (shared, {its: node, own: [i]})
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]] if above[0] < len(s) else _END] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """(numbers in order, each one's common prefix with the one before; 0 for the first)."""
        order, shared, todo = [], [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if type(node) is tuple:
                own, children = node
                chars = sorted(children, reverse=True)
                todo += [(children[c], own) for c in chars[:-1]] + [(children[chars[-1]], depth)]
            else:
                order += node
                shared += [depth] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, shared


def deep_shallow_sort(strings: list[bytes], shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before it in the order).

    Every string is ``shallow`` bytes long at least; ``shallow`` is a multiple of 8.
    """
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.frombuffer(b"".join(s[:shallow] for s in strings), ">u8").reshape(len(strings), -1).astype(np.uint64)
    order, shared = [], []
    for rows in _multikey_quicksort(words):
        if len(rows) == 1:
            own, depths = [int(rows[0])], [0]
        else:
            trie = BlindTrie(strings)
            for i in rows.tolist():
                trie.insert(i)
            own, depths = trie.ordered()
        if order:
            depths[0] = common_prefix(strings[order[-1]], strings[own[0]])
        order += own
        shared += depths
    return np.array(order), np.array(shared)
