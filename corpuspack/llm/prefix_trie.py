"""The trie of conversation prefixes, from balanced parentheses.

A turn is a symbol: a hash of its role and text, and its length. A conversation is a path
of symbols, and equal paths are one. Paths are sorted over all tasks, and every shard, a
bounded run of them, writes its part of the trie as parentheses in preorder. There,
``findclose`` on a tree of block minima of the excess delimits each subtree, the rank of
``()`` pairs counts its leaves, and cumulative arrays sum up what lies in it.

What is not on the way to a shard's first or last path lies in this shard only, and is
done. The two ways, or spines, are shared with other shards: with what hangs beside them
as weights they are the paths of a further, far smaller round, until one shard has all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import release_memory, stage

SPINE = 5  # turns at most that a conversation takes from its base
FAMILY = 100  # conversations that share a base
WIDTH = 20  # bytes of a symbol: 16 of a hash, 4 of a length
SHARD_BYTES = 16_000_000  # of paths
# Paths are dealt by so many bytes of them.
DEALT_BYTES = 100 * WIDTH
CHUNK_IDS = 4096

_MOST = np.iinfo(np.int64).max
_LOCAL = ("ended", "least", "leaves", "saved", "children")


def symbols(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of every conversation: its turns' symbols, one character a byte, in order.

    Turns go by ``turn``, null first, equal ones by the hash of role and text. Null roles
    and texts are empty. Rows without ``conv_id`` belong to no conversation; repeated rows
    are turns of their own. A conversation's symbols are one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length of the role tells where it ends
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    length = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    symbol = F.decode(F.concat(F.unhex(F.md5(whole.cast("binary"))), length), "ISO-8859-1")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), symbol.alias("symbol")).alias("t"),
    )
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["symbol"])
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, path``: the first turns of the base, then the conversation's own after as many."""
    table = stage(turns, "trie-turns")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    bases = table.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, SPINE).alias("spine")
    )
    joined = table.withColumn("base", base).join(bases, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SPINE + 1)).cast("int")
    first = F.coalesce(F.slice("spine", F.lit(1), h), F.array().cast("array<string>"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    path = F.encode(F.array_join(F.concat(first, own), ""), "ISO-8859-1")
    return joined.select("conv_id", path.alias("path"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each path's ids, from chunks sorted by path and then by id.

    Only a running hash is held, however many ids a path has.
    """
    key, running, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["key", "ends"]
        )

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                running.update(b"," + ids)
            else:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(ids)
        if len(done) >= CHUNK_IDS:
            yield out()
    if key is not None:
        done.append((key, running.hexdigest()))
    if done:
        yield out()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one path after each other, joined by commas, some thousand in a row."""
    names = ["key", "first", "ids"]
    for batch in batches:
        rows, key = [], None
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key or len(rows[-1][2]) >= CHUNK_IDS:
                rows.append((k, i, []))
                key = k
            rows[-1][2].append(b"%d" % i)
        kinds = (pa.binary(), pa.int64(), pa.binary())
        columns = zip(*[(k, i, b",".join(ids)) for k, i, ids in rows]) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)


def paths(built: DataFrame) -> DataFrame:
    """The distinct paths: ``path``, how many ``ended`` in it, the ``least`` id, and ``ends``."""
    keyed = stage(built.withColumn("key", F.unhex(F.md5("path"))), "trie-rebuilt")
    dealt = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id")
    chunks = dealt.sortWithinPartitions("key", "conv_id").mapInArrow(
        _chunks, "key binary, first bigint, ids binary"
    )
    ends = (
        chunks.repartition("key")
        .sortWithinPartitions("key", "first")
        .mapInArrow(_hashes, "key binary, ends string")
    )
    counted = keyed.groupBy("key").agg(
        F.any_value("path").alias("path"), F.count("*").alias("ended"), F.min("conv_id").alias("least")
    )
    return counted.join(ends, "key").select("path", "ended", "least", "ends")


class Parentheses:
    """A tree as balanced parentheses, in preorder."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        # block minima of twice as many places in each further level
        self._least = [self.excess]
        while len(self._least[-1]) > 1:
            a = self._least[-1]
            a = np.append(a, _MOST) if len(a) % 2 else a
            self._least.append(np.minimum(a[::2], a[1::2]))

    def findclose(self) -> np.ndarray:
        """Of every ``(``, the place of its ``)``: the first behind it with less excess.

        All climb the tree of minima together until a block to the right has such a
        place, and go down to it.
        """
        aim = self.excess[self.opens] - 1
        at, level = self.opens + 1, np.zeros(len(self.opens), np.int64)
        seeking = np.arange(len(at))
        for depth, least in enumerate(self._least):  # up
            met = least[np.minimum(at[seeking], len(least) - 1)] <= aim[seeking]
            level[seeking[met]] = depth
            seeking = seeking[~met]
            # the block beside, as far up as that lies within one that was not looked at
            at[seeking] = (at[seeking] + 1) // 2
        for depth in range(len(self._least) - 1, 0, -1):  # down
            going = np.flatnonzero(level >= depth)
            left = 2 * at[going]
            at[going] = left + (self._least[depth - 1][left] > aim[going])
            level[going] = depth - 1
        return at

    def leaf_rank(self) -> np.ndarray:
        """How many ``()`` pairs there are before each node in preorder, and in all."""
        leaf = ~self.bits[self.opens + 1]
        return np.concatenate([[0], np.cumsum(leaf)])


def _least_in(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least value in each range, of which none is empty, from minima of 2^k places."""
    found = np.empty(len(start), values.dtype)
    kind = np.frexp(end - start)[1] - 1
    table, k = values, 0
    while True:
        own = np.flatnonzero(kind == k)
        found[own] = np.minimum(table[start[own]], table[end[own] - (1 << k)])
        k += 1
        if 1 << k > len(values):
            return found
        half = 1 << (k - 1)
        table = np.minimum(table[:-half], table[half:])


@dataclass
class Item:
    """A path with weights at the nodes on it, from the root at depth 0."""

    path: bytes
    local: dict[str, np.ndarray]
    ends: list[str | None]


class Shard:
    """Sorted items as a trie, and what it says of each node."""

    def __init__(self, items: list[Item]):
        self._shared = [0]  # nodes that a path shares with the one before it
        for a, b in zip(items, items[1:]):
            self._shared.append(_common(a.path, b.path) + 1)
        self.depths = np.array([len(i.path) // WIDTH + 1 for i in items])
        shared = np.array(self._shared)
        new = self.depths - shared
        closed = np.append(self.depths[:-1] - shared[1:], self.depths[-1])
        runs = np.column_stack([new, closed]).reshape(-1)
        self.tree = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 0, runs))
        self.size = int(new.sum())
        self.depth = np.empty(self.size, np.int64)
        self.parent = np.empty(self.size, np.int64)
        self.item = np.repeat(np.arange(len(items)), new)
        self.local = {c: np.full(self.size, _MOST if c == "least" else 0, np.int64) for c in _LOCAL}
        self.ends: list[str | None] = [None] * self.size
        stack: list[int] = []
        at = 0
        for i, (item, keep, n) in enumerate(zip(items, self._shared, new.tolist())):
            del stack[keep:]
            if n:
                self.parent[at] = stack[-1] if stack else -1
                self.parent[at + 1 : at + n] = np.arange(at, at + n - 1)
                self.depth[at : at + n] = np.arange(keep, keep + n)
                stack.extend(range(at, at + n))
                at += n
            if i == 0:
                self.first = np.array(stack)
            self._add(item, stack)
        self.last = np.array(stack)

    def _add(self, item: Item, stack: list[int]) -> None:
        """Add an item's weights at its nodes; only its end has any if it is a plain path."""
        n = len(item.local["ended"])
        nodes = stack[len(stack) - n :]
        for name, values in item.local.items():
            own = self.local[name]
            own[nodes] = np.minimum(own[nodes], values) if name == "least" else own[nodes] + values
        for node, ends in zip(nodes[-len(item.ends) :], item.ends):
            self.ends[node] = ends or self.ends[node]

    def measure(self, items: list[Item]) -> None:
        """Work out every node from what lies in this shard."""
        tree = self.tree
        sizes = (tree.findclose() - tree.opens + 1) // 2
        self.start = np.arange(self.size)
        self.end = self.start + sizes
        self.n_convs = self._within(self.local["ended"])
        self.least = _least_in(self.local["least"], self.start, self.end)
        self.children = self.local["children"] + np.bincount(self.parent[1:], minlength=self.size)
        # a pair () is a leaf, unless children hang on it that are not in this shard
        rank = tree.leaf_rank()
        hidden = (sizes == 1) & (self.local["children"] > 0)
        self.leaves = rank[self.end] - rank[self.start] + self._within(self.local["leaves"] - hidden)
        own = (self.n_convs - 1) * self._lengths(items)
        self.saved = self._within(own + self.local["saved"])

    def _lengths(self, items: list[Item]) -> np.ndarray:
        """Of every node's last text; the root has none."""
        sizes = np.array([len(i.path) for i in items])
        data = np.frombuffer(b"".join(i.path for i in items), np.uint8)
        found = np.zeros(self.size, np.int64)
        below = np.flatnonzero(self.depth)
        at = (np.cumsum(sizes) - sizes)[self.item[below]] + self.depth[below] * WIDTH - 4
        for b in range(4):
            found[below] = found[below] * 256 + data[at + b]
        return found

    def spine(self) -> np.ndarray:
        """The nodes of the first and of the last path, in preorder."""
        return np.union1d(self.first, self.last)

    def spines(self, items: list[Item]) -> list[Item]:
        """The first and the last path, with what hangs beside them as weights."""
        on = np.zeros(self.size, bool)
        on[self.spine()] = True
        beside = np.flatnonzero(~on & on[self.parent])
        hanging = {c: v.copy() for c, v in self.local.items()}
        at = self.parent[beside]
        for name, own in (("ended", self.n_convs), ("leaves", self.leaves), ("saved", self.saved)):
            np.add.at(hanging[name], at, own[beside])
        np.add.at(hanging["children"], at, 1)
        np.minimum.at(hanging["least"], at, self.least[beside])
        only = self.last[np.isin(self.last, self.first).sum() :]
        found = []
        for item, nodes in ((items[0], self.first), (items[-1], only)):
            if len(nodes):
                local = {c: v[nodes] for c, v in hanging.items()}
                found.append(Item(item.path, local, [self.ends[n] for n in nodes.tolist()]))
        return found

    def keys(self, items: list[Item], nodes: np.ndarray) -> dict[int, bytes]:
        """A hash of the path of each of these nodes, which are in preorder."""
        found: dict[int, bytes] = {}
        before = None
        for node in nodes.tolist():
            path, depth = items[self.item[node]].path, int(self.depth[node])
            if before is not None and self.parent[node] == before:
                running = running.copy()
                running.update(path[(depth - 1) * WIDTH : depth * WIDTH])
            else:
                running = hashlib.md5(path[: depth * WIDTH])
            found[node], before = running.digest(), node
        return found

    def _within(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from cumulative sums in preorder."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.end] - sums[self.start]


def _common(a: bytes, b: bytes) -> int:
    """Symbols that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(np.argmax(differ)) // WIDTH


_ITEM = "path binary, " + ", ".join(f"{c} array<bigint>" for c in _LOCAL) + ", ends array<string>"
_NODE = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_ITEM_TYPES = [pa.binary(), *[pa.list_(pa.int64())] * len(_LOCAL), pa.list_(pa.string())]
_NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def _batch(items: list[tuple], nodes: list) -> pa.RecordBatch:
    """Rows of items and of nodes, each with nulls in the other's columns."""
    n, m = len(items), len(nodes[0])
    columns = [
        pa.array([row[i] for row in items] + [None] * m, kind) for i, kind in enumerate(_ITEM_TYPES)
    ]
    columns += [
        pa.concat_arrays([pa.nulls(n, kind), pa.array(own, kind)])
        for own, kind in zip(nodes, _NODE_TYPES)
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*_names(_ITEM), *_names(_NODE)])


def _nodes(shard: Shard, items: list[Item], done: np.ndarray, spine: np.ndarray, keyed: bool) -> list:
    """Columns of the nodes that are done, with their keys if others may wait for these."""
    on = np.zeros(shard.size, bool)
    on[spine] = True
    parent = shard.parent[done]
    waits = (parent >= 0) & on[parent]
    above = shard.keys(items, spine)
    own = shard.keys(items, done) if keyed else {}
    return [
        [own.get(node) for node in done.tolist()],
        [above[p] if w else None for p, w in zip(parent.tolist(), waits.tolist())],
        shard.least[done],
        shard.depth[done],
        pa.array(shard.least[parent], pa.int64(), mask=(parent < 0) | waits),
        shard.n_convs[done],
        shard.children[done],
        shard.leaves[done],
        shard.saved[done],
        [shard.ends[node] for node in done.tolist()],
    ]


def _encode(items: list[Item], last: bool, keyed: bool) -> pa.RecordBatch:
    """The nodes of a shard that are done, and its spines; all are done in the last round."""
    shard = Shard(items)
    shard.measure(items)
    spine = np.zeros(0, np.int64) if last else shard.spine()
    done = np.setdiff1d(np.arange(shard.size), spine)
    left = [] if last else shard.spines(items)
    rows = [(i.path, *[i.local[c] for c in _LOCAL], i.ends) for i in left]
    return _batch(rows, _nodes(shard, items, done, spine, keyed))


def _shards(shard_bytes: int, last: bool, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[Item] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                local = {c: np.array(row[c], np.int64) for c in _LOCAL}
                items.append(Item(row["path"], local, row["ends"]))
                size += len(row["path"]) + 8 * len(_LOCAL) * len(row["ended"])
                # several items at least, so that there are fewer in each round
                if not last and size >= shard_bytes and len(items) >= 8:
                    yield _encode(items, False, keyed)
                    items, size = [], 0
        if items:
            yield _encode(items, last, keyed)
        del items
        release_memory()

    return run


def trie(conversations: DataFrame, shard_bytes: int | None = None) -> DataFrame:
    """Every node of the trie of rebuilt conversations, as ``conv_id, depth, parent_conv_id, ...``.

    ``conv_id`` is the smallest member; with ``depth`` it names a node, as
    ``parent_conv_id`` with a depth one less names the parent. ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` as the names say;
    without conversations there is no node. Nulls, ties and repeated rows as in
    ``symbols``; columns but ``conv_id, turn, role, text`` are not read.
    """
    found = paths(rebuilt(symbols(conversations)))
    one = [F.array(F.col(c) if c in ("ended", "least") else F.lit(0).cast("bigint")).alias(c) for c in _LOCAL]
    items = stage(found.select("path", *one, F.array("ends").alias("ends")), "trie-paths")
    most = shard_bytes or SHARD_BYTES
    done, round_ = [], 0
    while True:
        weight = F.octet_length("path") + 8 * len(_LOCAL) * F.size("ended")
        n, size = items.agg(F.count("*"), F.sum(weight.cast("bigint"))).first()
        parts = min((size or 0) // most, n // 16)
        last = parts <= 1
        if last:
            dealt = items.repartition(1)
        elif round_:
            dealt = items.repartitionByRange(parts, F.substring("path", 1, DEALT_BYTES))
        else:
            dealt = items.repartitionByRange(F.substring("path", 1, DEALT_BYTES))
        made = stage(
            dealt.sortWithinPartitions("path").mapInArrow(_shards(most, last, round_ > 0), f"{_ITEM}, {_NODE}"),
            "trie-round",
        )
        done.append(made.filter("depth IS NOT NULL").select(*_names(_NODE)))
        if last:
            break
        items, round_ = made.filter("path IS NOT NULL").select(*_names(_ITEM)), round_ + 1
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    if round_:  # nodes below a spine learn from it who their parent is
        keys = done[1].select(F.col("key").alias("of"), F.col("conv_id").alias("above"))
        for more in done[2:]:
            keys = keys.unionByName(more.select(F.col("key").alias("of"), F.col("conv_id").alias("above")))
        waiting = nodes.filter("parent_key IS NOT NULL").join(keys, F.col("parent_key") == F.col("of"))
        waiting = waiting.withColumn("parent_conv_id", F.col("above")).select(*nodes.columns)
        nodes = nodes.filter("parent_key IS NULL").unionByName(waiting)
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.select(
        *[c for c in _names(_NODE) if c not in ("key", "parent_key", "ends_sha256")],
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


# crc32 of the ids in decimal, bit by bit
_CRC = """list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1),
        lambda i: ascii(substr(c::VARCHAR, i::INTEGER, 1))::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

ORACLE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(
           strlen(coalesce(role, ''))::VARCHAR, ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor({_CRC}, 4294967295) % {SPINE + 1} AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns)),
taken AS (
  SELECT c, 0 AS own, pos, role, text FROM convs JOIN turns ON conv_id = c - c % {FAMILY} AND pos <= h
  UNION ALL
  SELECT c, 1, pos, role, text FROM convs JOIN turns ON conv_id = c AND pos > h),
whole AS (
  SELECT c, coalesce(list(struct_pack(role, text) ORDER BY own, pos) FILTER (role IS NOT NULL), []) AS path
  FROM convs LEFT JOIN taken USING (c) GROUP BY c),
prefixes AS (
  SELECT c, path, d, path[1:d] AS node FROM (SELECT c, path, unnest(range(len(path) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len(path)), '')) AS ends
  FROM prefixes GROUP BY node, d),
related AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.node[1:n.d] = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1])
SELECT a.conv_id, a.d AS depth, any_value(a.parent_conv_id) AS parent_conv_id,
       any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
       count_if(b.n_children = 0)::BIGINT AS n_leaves,
       sum((b.n_convs - 1) * coalesce(length(b.node[b.d].text), 0))::BIGINT AS saved_tokens,
       any_value(a.ends) AS ends_sha256
FROM related a JOIN related b ON b.d >= a.d AND b.node[1:a.d] = a.node
GROUP BY a.conv_id, a.d
"""
