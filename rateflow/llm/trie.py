"""Conversation prefix trie in balanced parentheses, shard by shard.

Conversations are paths of turns. Distinct paths in lexicographic order are range-partitioned and
cut into shards; a shard writes its trie as balanced parentheses in preorder, with the least and
greatest excess of every block in a tree above them. ``findclose`` delimits a node's subtree, the
rank of leaf pairs counts its leaves, and cumulative arrays over the preorder give its savings.

Only the first and the last path of a shard can share nodes with another one. These spines stay open:
they carry what hangs complete below them, and the spines of neighbouring shards merge by groups,
level by level, until one group is left. Every other node is final where it was built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common


class Parentheses:
    """A balanced bit sequence (1 opens) with range min-max blocks of its excess."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        self.excess = excess
        far = np.iinfo(np.int32).max
        blocks = max(1, -(-len(bits) // self.BLOCK))
        held = np.full(blocks * self.BLOCK, far, dtype=np.int32)
        held[: len(bits)] = excess
        self.rows = held.reshape(blocks, self.BLOCK)
        top = np.where(self.rows == far, -1, self.rows)
        self.least, self.most = [self.rows.min(1)], [top.max(1)]
        while len(self.least[-1]) > 1:
            low, high = self.least[-1], self.most[-1]
            if len(low) % 2:
                low, high = np.r_[low, far], np.r_[high, -1]
                self.least[-1], self.most[-1] = low, high
            self.least.append(low.reshape(-1, 2).min(1))
            self.most.append(high.reshape(-1, 2).max(1))

    def _holds(self, level: int, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        return (self.least[level][node] <= value) & (value <= self.most[level][node])

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing position of each opening position."""
        out = np.full(len(opens), -1, dtype=np.int64)
        columns = np.arange(self.BLOCK)
        for a in range(0, len(opens), 1 << 15):
            at = opens[a : a + (1 << 15)]
            value = self.excess[at] - 1
            block, offset = at // self.BLOCK, at % self.BLOCK
            hit = (self.rows[block] == value[:, None]) & (columns > offset[:, None])
            near = hit.any(1)
            part = np.where(near, block * self.BLOCK + hit.argmax(1), -1)
            rest = np.flatnonzero(~near)
            node, level, wanted = block[rest], np.zeros(len(rest), dtype=np.int64), value[rest]
            rising = np.ones(len(rest), dtype=bool)
            for lev in range(len(self.least) - 1):  # up to the first block group on the right that holds the value
                i = np.flatnonzero(rising)
                right = (node[i] % 2 == 0) & self._holds(lev, np.minimum(node[i] + 1, len(self.least[lev]) - 1), wanted[i])
                done, up = i[right], i[~right]
                node[done] += 1
                level[done] = lev
                rising[done] = False
                node[up] //= 2
            for lev in range(len(self.least) - 1, 0, -1):  # down to its first block
                i = np.flatnonzero(level == lev)
                left = 2 * node[i]
                node[i] = np.where(self._holds(lev - 1, left, wanted[i]), left, left + 1)
                level[i] = lev - 1
            if len(rest):
                part[rest] = node * self.BLOCK + (self.rows[node] == wanted[:, None]).argmax(1)
            out[a : a + (1 << 15)] = part
        return out


NODES = (
    "open BOOLEAN, level INT, part INT, shard INT, pos INT, node BINARY, depth BIGINT, n BIGINT, least BIGINT, size BIGINT, "
    "ends BINARY, kids BIGINT, leaves BIGINT, saved BIGINT, parent BINARY, parent_open BOOLEAN, parent_least BIGINT"
)
_KINDS = {"BOOLEAN": pa.bool_(), "INT": pa.int32(), "BIGINT": pa.int64(), "BINARY": pa.binary()}
_NODES = pa.schema([(f.split(" ")[0], _KINDS[f.split(" ")[1]]) for f in NODES.split(", ")])
#: Fields of a node that is still open: what is known of it and of all that is complete below it.
CARRIED = ["node", "depth", "n", "least", "size", "ends", "kids", "leaves", "saved"]


class Shard:
    """A part of the trie, filled in preorder from its first path to its last."""

    def __init__(self):
        self.rows: list[list] = []  # fields of CARRIED
        self.parents: list[int] = []
        self.path: list[int] = []  # nodes of the last path

    def add(self, node, depth, n, least, size, ends, kids=0, leaves=0, saved=0) -> int:
        """Put one node: it is the one at its depth of the last path, or the next in preorder."""
        if depth < len(self.path):
            at = self.path[depth]
            row = self.rows[at]
            if row[0] == node:
                row[2] += n
                row[3] = min(row[3], least)
                row[5] = ends if row[5] is None else row[5]
                row[6] += kids
                row[7] += leaves
                row[8] += saved
                return at
            del self.path[depth:]
        self.rows.append([node, depth, n, least, size, ends, kids, leaves, saved])
        self.parents.append(self.path[depth - 1] if depth else -1)
        self.path.append(len(self.rows) - 1)
        return len(self.rows) - 1

    def result(self, level: int, part: int, shard: int, last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of ``NODES``; with ``last`` no node stays open."""
        fields = dict(zip(CARRIED, zip(*self.rows, strict=True), strict=True))
        count = len(self.rows)
        number = {c: np.array(fields[c], dtype=np.int64) for c in ("depth", "n", "least", "size", "kids", "leaves", "saved")}
        depth, parent = number["depth"], np.array(self.parents, dtype=np.int64)
        # a node opens after everything that ends before it: position = nodes before it + those closed
        opens = 2 * np.arange(count) - depth
        bits = np.zeros(2 * count, dtype=np.uint8)
        bits[opens] = 1
        tree = Parentheses(bits)
        closes = tree.findclose(opens)
        after = np.arange(count) + (closes - opens + 1) // 2  # preorder end of the subtree
        below = np.bincount(parent[1:], minlength=count)  # children in this shard
        # rank of pairs "()" that are leaves of the whole trie: nothing complete hangs below them
        pair = np.zeros(2 * count + 1, dtype=np.int64)
        pair[opens + 1] = (closes == opens + 1) & (number["kids"] == 0)
        rank = np.cumsum(pair)
        held = np.r_[0, np.cumsum(number["leaves"])]
        leaves = rank[closes] - rank[opens] + held[after] - held[np.arange(count)]
        own = (number["n"] - 1) * number["size"] + number["saved"]
        sums = np.r_[0, np.cumsum(own)]
        saved = sums[after] - sums[np.arange(count)]
        kids = number["kids"] + below
        open_ = np.zeros(count, dtype=bool)
        if not last:
            open_[self.path] = True
            open_[: int((depth == np.arange(count)).argmin()) if (depth != np.arange(count)).any() else count] = True
            # an open node carries its complete children only
            whole = np.flatnonzero(~open_)
            top = whole[open_[parent[whole]]]
            for name, value in (("kids", np.ones(count, dtype=np.int64)), ("leaves", leaves), ("saved", saved)):
                carried = number[name].copy()
                np.add.at(carried, parent[top], value[top])
                number[name] = carried
        kids, leaves, saved = (np.where(open_, number[c], v) for c, v in (("kids", kids), ("leaves", leaves), ("saved", saved)))
        above = np.maximum(parent, 0)
        parent_open = open_[above] & (parent >= 0)
        known = (parent >= 0) & ~parent_open
        least = number["least"]
        nodes, ends = fields["node"], fields["ends"]
        for a in range(0, count, 1 << 15):
            b = min(count, a + (1 << 15))
            whole_ = slice(a, b)
            new = {
                "open": pa.array(open_[whole_]), "level": pa.array([level] * (b - a), pa.int32()), "part": pa.array([part] * (b - a), pa.int32()),
                "shard": pa.array([shard] * (b - a), pa.int32()), "pos": pa.array(np.arange(a, b), pa.int32()),
                "node": pa.array(nodes[a:b], pa.binary()), "ends": pa.array(ends[a:b], pa.binary()),
                "kids": pa.array(kids[whole_]), "leaves": pa.array(leaves[whole_]), "saved": pa.array(saved[whole_]),
                "parent": pa.array([nodes[p] if p >= 0 else None for p in parent[whole_].tolist()], pa.binary()),
                "parent_open": pa.array(parent_open[whole_]),
                "parent_least": pa.array(least[above[whole_]], pa.int64(), mask=~known[whole_]),
            }
            new |= {c: pa.array(number[c][whole_]) for c in ("depth", "n", "least", "size")}
            yield pa.RecordBatch.from_arrays([new[f.name] for f in _NODES], schema=_NODES)


def _shards(most: int):
    """``mapInArrow`` of ordered distinct paths (least, n, ends, digests, sizes): shards of about ``most`` nodes."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        shard, before, hashes = Shard(), [], [hashlib.md5()]
        for batch in batches:
            for least, n, ends, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("least", "n", "ends", "digests", "sizes")), strict=True):
                if len(shard.rows) >= most:
                    yield from shard.result(1, part, made, False)
                    made, shard = made + 1, Shard()
                alike = 0
                for x, y in zip(before, digests, strict=False):
                    if x != y:
                        break
                    alike += 1
                del hashes[alike + 1 :]
                for d in digests[alike:]:
                    h = hashes[-1].copy()
                    h.update(d)
                    hashes.append(h)
                before, end = digests, len(digests)
                if len(shard.path) > alike:  # the shared nodes are the last path's
                    for at in shard.path[: alike + 1]:
                        row = shard.rows[at]
                        row[2] += n
                        row[3] = min(row[3], least)
                    if end == alike:
                        shard.rows[shard.path[end]][5] = ends
                    todo = range(alike + 1, end + 1)
                else:
                    todo = range(end + 1)
                for depth in todo:
                    shard.add(hashes[depth].digest(), depth, n, least, sizes[depth - 1] if depth else 0, ends if depth == end else None)
        if shard.rows:
            yield from shard.result(1, part, made, False)

    return run


def _merge(level: int, last: bool):
    """``mapInArrow`` of open nodes ordered by (grp, part, shard, pos): one shard for each grp."""

    def run(batches):
        group, shard = None, Shard()
        for batch in batches:
            for grp, *row in zip(batch.column("grp").to_pylist(), *(batch.column(c).to_pylist() for c in CARRIED), strict=True):
                if grp != group and shard.rows:
                    yield from shard.result(level, group, 0, last)
                    shard = Shard()
                group = grp
                shard.add(*row)
        if shard.rows:
            yield from shard.result(level, group, 0, last)

    return run


ENDS = "seq BINARY, least BIGINT, n BIGINT, ends BINARY"


def ends_of(paths: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """(seq, least, n, ends): for every distinct path its smallest conv_id, their number, and the
    SHA-256 of all of them in ascending order, joined by commas.

    Ids are ordered over ranges of (seq, conv_id), so copies of one path spread over tasks, which
    join them to pieces of at most ``piece`` ids; the hash of a path then runs over its pieces.
    """
    schema = "seq BINARY, least BIGINT, n BIGINT, ids STRING"

    def pack(batches):
        seq, ids = None, []
        for batch in batches:
            out = []
            for s, c in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (s != seq or len(ids) >= piece):
                    out.append((seq, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                seq = s
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["seq", "least", "n", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])], names=["seq", "least", "n", "ids"]
            )

    def digest(batches):
        seq, least, n, h = None, None, 0, None
        for batch in common.pieces(batches, "ids", 8 << 20):
            out = []
            for s, first, k, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "least", "n", "ids")), strict=True):
                if s != seq:
                    if h is not None:
                        out.append((seq, least, n, h.digest()))
                    seq, least, n, h = s, first, 0, hashlib.sha256()
                elif n:
                    h.update(b",")
                h.update(ids.encode())
                n += k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["seq", "least", "n", "ends"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([least], pa.int64()), pa.array([n], pa.int64()), pa.array([h.digest()], pa.binary())], names=["seq", "least", "n", "ends"])

    ordered = paths.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    packed = ordered.mapInArrow(pack, schema).repartition("seq").sortWithinPartitions("seq", "least")
    return packed.mapInArrow(digest, ENDS)


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns ARRAY<STRUCT<digest, size>>): the turns of each conversation in order of turn.

    Null turns come first; equal turns are ordered by their digest, repeated rows are all kept. Null
    role or text is empty; rows without conv_id belong to no conversation. Only 16 bytes of digest
    and the text's length are moved; a conversation is one row of 24 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.md5(content)).alias("digest"), F.octet_length(text).cast("bigint").alias("size"),
    )
    # five conversations that rebuild from one meet in one partition, now and in ``rebuilt``
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).repartition("base")
    rows = turns.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("t"))
    return rows.select("base", "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 5, then c's own after its first h.

    h = crc32 of c in decimal, modulo 9. All turns if there are fewer, none if that conversation is absent.
    """
    opening = paths.where("conv_id = base").select("base", F.slice("turns", 1, 8).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    nothing = F.slice("turns", 1, 0)
    joined = paths.join(opening, "base", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("opening", nothing), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def trie(paths: DataFrame, shard_nodes: int = 1 << 17, fan_in: int = 64) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): node, parent, depth, least, parent_least, n, kids, leaves, saved, ends.

    ``node`` is the MD5 of the path's digests; ``least`` the smallest conv_id of its members, ``n`` their
    number; ``saved`` sums (n - 1) * size over the subtree; ``ends`` is the SHA-256 of the ids that end
    here (null: none). conv_id must be unique. ``shard_nodes`` bounds a shard (a path is never cut),
    ``fan_in`` is how many partitions' spines one task merges.
    """
    joined = F.array_join(F.transform("turns", lambda t: t["digest"].cast("string")), "").cast("binary")
    held = common.stored(paths.select("conv_id", F.unhex(F.md5(joined)).alias("seq"), "turns"), "paths")
    ends = ends_of(held).select("least", "n", "ends")
    chosen = held.select(F.col("conv_id").alias("least"), F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes")).join(ends, "least")
    ordered = chosen.repartitionByRange("digests").sortWithinPartitions("digests")
    levels = [common.stored(ordered.mapInArrow(_shards(shard_nodes), NODES), "trie")]
    parts = (levels[0].where("open").agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, last = len(levels) + 1, parts <= fan_in
        rows = levels[-1].where("open").withColumn("grp", F.floor(F.col("part") / fan_in).cast("int"))
        rows = rows.repartition("grp").sortWithinPartitions("grp", "part", "shard", "pos")
        levels.append(common.stored(rows.select("grp", *CARRIED).mapInArrow(_merge(level, last), NODES), "trie"))
        if last:
            break
        parts = -(-parts // fan_in)
    # parents that were open when a child was final: known under the child's shard, so no key is hot
    final = levels[1].where("NOT open")
    opened = levels[0].where("open")
    every = levels[0].where("NOT open")
    for t in levels[2:]:
        final = final.union(t.where("NOT open"))
    for t in levels[1:-1]:
        opened = opened.union(t.where("open"))
    for t in levels[1:]:
        every = every.union(t.where("NOT open"))
    shard = ["level", "part", "shard"]
    known = opened.select(*shard, "node").join(final.select("node", "least"), "node").select(*shard, F.col("node").alias("parent"), F.col("least").alias("of_parent"))
    columns = ["node", "parent", "depth", "least", "parent_least", "n", "kids", "leaves", "saved", "ends"]
    direct = every.where("NOT parent_open").select(*columns)
    late = every.where("parent_open").drop("parent_least").join(known.withColumnRenamed("of_parent", "parent_least"), [*shard, "parent"])
    return direct.union(late.select(*columns))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    nodes = trie(rebuilt(paths_of(common.table(spark, sf_dir, "conversations"))))
    none = hashlib.sha256().hexdigest()
    return nodes.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("ends")), F.lit(none)).alias("ends_sha256"),
    )


#: Turns by window, nodes by their path as text, subtrees by joining a node with its smallest
#: member's path. CRC-32 by its table, as DuckDB has no function for it.
ORACLE = """
WITH rest AS (
    SELECT i, list_reduce([CAST(i AS BIGINT)] || [0 FOR x IN range(8)], lambda r, x: xor(r >> 1, 3988292384 * (r & 1))) AS r FROM range(256) AS b(i)
), tab AS (
    SELECT list(r ORDER BY i) AS t FROM rest
), turns AS (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
           md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, size, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM turns
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(list_reduce([4294967295] || [CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT) FOR i IN range(1, length(CAST(conv_id AS VARCHAR)) + 1)],
                           lambda r, x: xor(r >> 8, t[(xor(r, x) & 255) + 1])), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM own), tab
), joined AS (
    SELECT c.conv_id, o.pos, o.d, o.size FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
    UNION ALL
    SELECT c.conv_id, o.pos + 1000000000, o.d, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), steps AS (
    SELECT conv_id, size, row_number() OVER w AS depth, string_agg(d, '') OVER w AS node FROM joined
    WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), members AS MATERIALIZED (
    SELECT conv_id, depth, node, size FROM steps UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), lengths AS (
    SELECT conv_id, max(depth) AS len FROM members GROUP BY 1
), nodes AS MATERIALIZED (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends
    FROM members JOIN lengths USING (conv_id) GROUP BY node, depth
), kids AS (
    SELECT node[1:length(node) - 32] AS node, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS MATERIALIZED (
    SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (node)
), subtrees AS (
    SELECT m.node, sum(CASE WHEN x.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.size) AS saved
    FROM full_nodes x JOIN members m ON m.conv_id = x.conv_id AND m.depth <= x.depth GROUP BY 1
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN subtrees s USING (node) LEFT JOIN full_nodes p ON x.depth > 0 AND p.node = x.node[1:length(x.node) - 32]
"""
