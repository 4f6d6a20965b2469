"""A compressed radix (Patricia) trie over byte strings that keeps an owner for each string, and spills subtrees."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

from ..sources.paths import arrow_filesystem

#: Bytes that a node costs beside its edge.
NODE_BYTES = 250

Owner = tuple  # (code points, id or None, number of rows)


def better(a: Owner, b: Owner) -> Owner:
    """The owner with more code points, then the smaller id, nulls last; rows add up."""
    first = a if (-a[0], a[1] is None, a[1] or 0) <= (-b[0], b[1] is None, b[1] or 0) else b
    return (first[0], first[1], a[2] + b[2])


def common_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Spill:
    """Entries of a subtree that left the trie: a file of the shared folder, or memory where no folder is given."""

    def __init__(self, folder: str | None, name: str):
        self.fs = self.path = None
        if folder is None:
            self.out = io.BytesIO()
        else:
            self.fs, root = arrow_filesystem(folder)
            self.fs.create_dir(root, recursive=True)
            self.path = f"{root}/{name}"
            self.out = self.fs.open_output_stream(self.path, buffer_size=1 << 18)

    def add(self, entry: tuple[bytes, Owner]) -> None:
        self.out.write(pickle.dumps(entry))

    def entries(self) -> Iterator[tuple[bytes, Owner]]:
        """All entries, once; the file goes."""
        if self.path is None:
            self.out.seek(0)
            file = self.out
        else:
            self.out.close()
            file = self.fs.open_input_stream(self.path, buffer_size=1 << 18)
        with file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    break
        if self.path is not None:
            self.fs.delete_file(self.path)


class Node:
    __slots__ = ("children", "edge", "owner", "spill")

    def __init__(self, edge: bytes, owner: Owner | None = None):
        self.edge, self.owner, self.children, self.spill = edge, owner, {}, None


class RadixTrie:
    """Strings share their prefixes; a terminal node holds the owner of its string.

    With a `budget` in bytes, the heaviest subtree below the first branching moves to a file of `folder`, named after
    `name`, when the trie outgrows it. Later strings of that subtree are appended to the file, and `items` builds a trie
    of each file in turn, so memory stays bounded whatever the number of strings. A lost task's files stay with the
    other scratch tables; the task that takes its place writes its own.
    """

    def __init__(self, budget: int | None = None, folder: str | None = None, name: str = "trie"):
        self.root, self.budget, self.held = Node(b""), budget, 0
        self.folder, self.name, self.spills = folder, name, 0

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at, end = self.root, 0, len(key)
        while True:
            if node.spill is not None:
                node.spill.add((key, owner))
                return
            if at == end:
                node.owner = owner if node.owner is None else better(node.owner, owner)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self.held += end - at + NODE_BYTES
                break
            if key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            shared = common_length(child.edge, key[at:])
            middle = Node(child.edge[:shared])
            child.edge = child.edge[shared:]
            middle.children[child.edge[0]] = child
            node.children[key[at]] = middle
            self.held += NODE_BYTES
            node, at = middle, at + shared
        if self.budget is not None and self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Moves the heaviest subtree below the first node with a choice to a file."""
        node, path = self.root, b""
        while len(node.children) == 1 and not node.spill:
            (child,) = node.children.values()
            if child.spill is not None or not child.children:
                break
            node, path = child, path + child.edge
        choices = [(self._weight(x), x) for x in node.children.values() if x.spill is None]
        if sum(1 for _, x in choices if x.children or len(choices) > 1) == 0:
            self.budget = 2 * self.held  # one string alone, which has to be held anyway
            return
        weight, child = max(choices, key=lambda x: x[0])
        out = Spill(self.folder, f"{self.name}-{self.spills}")
        self.spills += 1
        for entry in self._walk(child, path):
            out.add(entry)
        child.children, child.owner, child.spill = {}, None, out
        self.held -= weight

    def _weight(self, top: Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.edge) + NODE_BYTES
            stack.extend(node.children.values())
        return total

    def _walk(self, top: Node, path: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(top, path)]
        while stack:
            node, path = stack.pop()
            path += node.edge
            if node.owner is not None:
                yield path, node.owner
            if node.spill is not None:
                yield from self._unspill(node.spill)
                node.spill = None
            stack.extend((child, path) for child in node.children.values())

    def _unspill(self, spill: Spill) -> Iterator[tuple[bytes, Owner]]:
        inner = RadixTrie(self.budget, self.folder, f"{self.name}-{self.spills}x")
        self.spills += 1
        for entry in spill.entries():
            inner.insert(*entry)
        yield from inner.items()

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        """Every string with its owner, once."""
        yield from self._walk(self.root, b"")
