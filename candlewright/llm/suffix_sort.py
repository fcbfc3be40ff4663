"""Deep-shallow sorting of byte strings: order and common prefixes with the neighbour.

A multikey quicksort orders strings to a shallow depth, one 8-byte word at a time and only inside
groups that are still equal.  Groups that share the whole shallow prefix go to blind tries: a trie
holds branching positions and branching bytes alone, a string walks it without comparing, is then
compared once with the leaf it reached, and is inserted where they part.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class BlindTrie:
    """Orders strings with a long common prefix.  A node is [depth, {byte: node or leaf}]; byte -1
    stands for the end of a string.  Equal strings share a leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None
        self.same: dict[int, list[int]] = {}

    def _byte(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(self._byte(s, node[0])) if self._byte(s, node[0]) in node[1] else next(iter(node[1].values()))
        common = common_prefix(s, self.strings[node])
        if common == len(s) == len(self.strings[node]):
            self.same.setdefault(node, []).append(i)
            return
        above, edge, node = None, None, self.root
        while isinstance(node, list) and node[0] < common:
            above, edge = node, self._byte(s, node[0])
            node = node[1][edge]
        if isinstance(node, list) and node[0] == common:
            node[1][self._byte(s, common)] = i
            return
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        made = [common, {self._byte(self.strings[leaf], common): node, self._byte(s, common): i}]
        if above is None:
            self.root = made
        else:
            above[1][edge] = made

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order, and each one's common prefix with the one before it (0 for the first)."""
        order: list[int] = []
        common: list[int] = []
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                inside = [node[1][b] for b in sorted(node[1])]
                stack.extend((x, node[0]) for x in reversed(inside[1:]))
                stack.append((inside[0], shared))
            else:
                order.append(node)
                common.append(shared)
                for other in self.same.get(node, ()):
                    order.append(other)
                    common.append(len(self.strings[other]))
        return order, common


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, bytes), and the length of the prefix that each shares with
    the string before it in the same group (0 for the first of a group)."""
    n = len(strings)
    width = SHALLOW // 8
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, width).astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    tied = np.zeros(n, bool)  # ordered place ties with the one before it
    tied[1:] = groups[order][1:] == groups[order][:-1]
    for k in range(width):
        part = np.cumsum(~tied)
        open_ = tied | np.append(tied[1:], False)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        keys = head[order[at], k]
        inner = np.lexsort((keys, part[at]))
        order[at] = order[at][inner]
        keys, part = keys[inner], part[at]
        same = np.zeros(len(at), bool)
        same[1:] = (part[1:] == part[:-1]) & (keys[1:] == keys[:-1])
        tied[at] = same
    common = np.zeros(n, np.int64)
    grouped = groups[order]
    starts = np.flatnonzero(~tied)
    sizes = np.diff(np.append(starts, n))
    for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        trie = BlindTrie(strings)
        for i in order[at : at + size].tolist():
            trie.insert(i)
        order[at : at + size], common[at : at + size] = trie.ordered()
    for at in starts[1:].tolist():  # neighbours in a group that the shallow sort told apart
        if grouped[at] == grouped[at - 1]:
            common[at] = common_prefix(strings[order[at - 1]], strings[order[at]])
    for at in starts.tolist():
        if not at or grouped[at] != grouped[at - 1]:
            common[at] = 0
    return order, common


def repeated_offsets(left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray, groups: np.ndarray, span: int) -> np.ndarray:
    """For strings that share an anchor within their group: which windows occur twice.

    ``left`` holds the bytes before the anchor, nearest first, ``right`` those from the anchor on.
    The window at offset o begins o bytes before the anchor and is ``span`` long; string i has the
    windows least[i]..most[i].  Two windows at one offset are equal iff o bytes agree on the left
    and span - o on the right, so sorted order and common prefixes on both sides decide.  Returns a
    matrix of booleans: string by offset."""
    n = len(left)
    by_left, common_left = deep_shallow(left, groups)
    by_right, common_right = deep_shallow(right, groups)
    new = np.ones(n, bool)
    new[1:] = groups[by_left][1:] != groups[by_left][:-1]
    new_right = np.ones(n, bool)
    new_right[1:] = groups[by_right][1:] != groups[by_right][:-1]
    found = np.zeros((n, int(most.max()) + 1), bool)
    class_left, class_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        active = np.flatnonzero((least <= o) & (o <= most))
        if len(active) < 2:
            continue
        class_left[by_left] = np.cumsum(new | (common_left < o))
        class_right[by_right] = np.cumsum(new_right | (common_right < span - o))
        key = class_left[active] * (n + 1) + class_right[active]
        rank = np.argsort(key, kind="stable")
        same = key[rank][1:] == key[rank][:-1]
        twice = np.append(same, False) | np.append(False, same)
        found[active[rank[twice]], o] = True
    return found
