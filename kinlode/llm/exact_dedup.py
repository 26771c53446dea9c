"""Exact dedup by Patricia-trie owners.

Texts are dealt out by length and content hash. Each task inserts the full byte strings into a compressed radix trie
whose terminal nodes hold the owner of the text; a trie that outgrows its memory spills subtrees to unnamed task-local
files and works them off afterwards. A first trie on the map side leaves one representative of a text for each
MAP_BYTES of distinct texts, so a text that fills a third of the table is shuffled a few times for each task and not
once for each row.

Defined results: a null text is an empty text. The row with the largest (or smallest) id owns its group; a null id owns
only a group without other ids. Rows that repeat an id and a text are members of one group; all of them count, the
report marks each of them with the same `kept`, and keep_rows() keeps one of them. Empty tables give empty results.
Other columns, whatever their names, are carried by keep_rows() and ignored by owners(). A text longer than a trie's
memory is compared whole in memory like any other; it is never cut.
"""

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlode.llm import common

#: Bytes of labels and nodes that a trie holds before it spills, and before the map side hands it on.
TRIE_BYTES, MAP_BYTES = 32 << 20, 16 << 20
#: What a node takes besides its label.
_NODE = 200


class _Node:
    __slots__ = ("children", "file", "label", "value")

    def __init__(self, label: bytes):
        self.label, self.children, self.value, self.file = label, {}, None, None


def _common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Byte strings with a value each; merge(old, new) combines the values of equal strings. A spilled node has a file in
    place of children: what goes on below it is appended there."""

    def __init__(self, merge, limit: int = TRIE_BYTES):
        self.merge, self.limit, self.full, self.root, self.held = merge, limit, limit, _Node(b""), 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key[at:], value), node.file)
                return
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                child.value = value
                self.held += len(child.label) + _NODE
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _common_prefix(child.label, key[at : at + len(child.label)])
            node = self._split(node, child, n)
            at += n
        if self.held > self.full:
            self._spill()

    def _split(self, parent: _Node, child: _Node, n: int) -> _Node:
        """A new node for the first n bytes of the child's label, above the child."""
        upper = _Node(child.label[:n])
        child.label = child.label[n:]
        upper.children[child.label[0]] = child
        parent.children[upper.label[0]] = upper
        self.held += _NODE
        return upper

    @staticmethod
    def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, _Node]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            yield prefix, node
            stack.extend((c, prefix) for c in node.children.values())

    def _weights(self) -> dict[int, int]:
        """Bytes of the subtree below and with each node."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        out: dict[int, int] = {}
        for node in reversed(order):
            out[id(node)] = len(node.label) + _NODE + sum(out[id(c)] for c in node.children.values())
        return out

    def _spill(self) -> None:
        """Go down to where no subtree has more than half of the memory, or where it branches no more, and move the heaviest
        subtrees there to files until half of the memory is free. A label's first byte stays in the trie; a lone leaf stays."""
        weight, node = self._weights(), self.root
        while True:
            heaviest = max(node.children.values(), key=lambda c: weight[id(c)], default=None)
            if heaviest is None or not heaviest.children or weight[id(heaviest)] <= self.limit // 2:
                break
            node = heaviest
        below = sorted((c for c in node.children.values() if c.file is None), key=lambda c: -weight[id(c)])
        for child in below if len(below) > 1 or any(c.children for c in below) else ():
            if self.held <= self.limit // 2:
                break
            file = tempfile.TemporaryFile(prefix="trie-")  # has no name: it goes with the task, however that ends
            for rest, x in self._walk(child, b""):
                if x.value is not None:
                    pickle.dump((rest[1:], x.value), file)
                elif x.file is not None:
                    for more, value in self._load(x.file):
                        pickle.dump((rest[1:] + more, value), file)
            self.held -= weight[id(child)] - _NODE - 1
            kept = node.children[child.label[0]] = _Node(child.label[:1])
            kept.file = file
        self.full = max(self.limit, self.held + self.limit // 2)

    @staticmethod
    def _load(file) -> Iterator[tuple[bytes, object]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                break
        file.close()

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Each string once: what the trie holds, then the files, each through a trie of its own."""
        todo = [(b"", self)]
        while todo:
            head, trie = todo.pop()
            files = []
            for rest, node in trie._walk(trie.root, b""):
                if node.value is not None:
                    yield head + rest, node.value
                if node.file is not None:
                    files.append((head + rest, node.file))
            trie.root, trie.held = _Node(b""), 0
            for prefix, file in files:
                todo.append((prefix, file))
            while todo and not isinstance(todo[-1][1], PatriciaTrie):
                prefix, file = todo.pop()
                below = PatriciaTrie(self.merge, self.limit)
                for key, value in self._load(file):
                    below.insert(key, value)
                todo.append((prefix, below))


def _better(keep: str):
    def merge(a: tuple, b: tuple) -> tuple:
        """(id, rows, payload): the owner's id and payload, and the sum of rows."""
        if a[0] is None or b[0] is None:
            first = a if b[0] is None else b
        else:
            first = a if (a[0] >= b[0]) == (keep == "largest") or a[0] == b[0] else b
        return first[0], a[1] + b[1], first[2]

    return merge


def _slices(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[zip]:
    """The rows of a batch whose third column is the text, as Python tuples, about limit bytes of texts at a time."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(2)).to_pylist(), 1):
        size += n
        if size > limit or i == len(batch):
            part = batch.slice(at, i - at)
            yield zip(*(c.to_pylist() for c in part.columns), strict=True)
            at, size = i, 0


def _combine(keep: str, extra: list[str], final: bool):
    """A scan that inserts texts into a trie and emits one row for each text. On the map side the trie is handed on when
    it is full; on the reduce side rows come sorted by length and a trie ends with its length."""

    def flush(trie: PatriciaTrie, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {n: [] for n in schema.names}
        size = 0
        for text, (owner, n, payload) in trie.items():
            row = (payload[0], payload[1], text, owner, n, *payload[2:])
            for name, value in zip(schema.names, row, strict=True):
                rows[name].append(value)
            size += len(text) + 64
            if size > 2 << 20:
                yield pa.RecordBatch.from_pydict(rows, schema=schema)
                rows, size = {n: [] for n in schema.names}, 0
        if size:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, now, schema = _better(keep), None, None
        trie = PatriciaTrie(merge)
        for batch in batches:
            schema = batch.schema
            for rows in _slices(batch):
                for size, key, text, owner, n, *rest in rows:
                    if size != now if final else trie.held > MAP_BYTES:
                        yield from flush(trie, schema)
                        trie, now = PatriciaTrie(merge), size
                    trie.insert(text, (owner, n, (size, key, *rest)))
        if schema is not None:
            yield from flush(trie, schema)

    return scan


def _representatives(docs: DataFrame, keep: str, extra: list[str], id_col: str, text_col: str) -> DataFrame:
    """(size, sha, body, owner, n, _extra...): one row for each distinct text."""
    text = common.whole(text_col)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(F.octet_length(text).alias("size"), F.unhex(F.sha2(text, 256)).alias("sha"), F.encode(text, "UTF-8").alias("body"), F.col(id_col).alias("owner"), F.lit(1).cast("long").alias("n"), *[F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(extra)])
    schema = f"size int, sha binary, body binary, owner {kinds[id_col]}, n long" + "".join(f", _x{i} {kinds[c]}" for i, c in enumerate(extra))
    local = rows.mapInArrow(_combine(keep, extra, False), schema)
    dealt = local.repartition("size", "sha").sortWithinPartitions("size", "sha")
    return dealt.mapInArrow(_combine(keep, extra, True), schema)


def owners(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row. Members find their owner by SHA-256, which the
    tries have shown to stand for one byte string."""
    groups = _representatives(docs, keep, [], id_col, text_col).select(F.lower(F.hex("sha")).alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(common.whole(text_col), 256).alias("text_sha256"))
    out = rows.join(groups, "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: the owner's row comes straight from its trie node."""
    absent = "_absent"
    while absent in docs.columns:
        absent += "_"
    extra = [absent, *(c for c in docs.columns if c not in (id_col, text_col))]
    out = _representatives(docs.withColumn(absent, F.col(text_col).isNull()), keep, extra, id_col, text_col)
    at = {c: F.col(f"_x{i}") for i, c in enumerate(extra)} | {id_col: F.col("owner")}
    at[text_col] = F.when(~at[absent], F.col("body").cast("string"))
    return out.select(*[at[c].alias(c) for c in docs.columns])
