"""SimHash near-duplicates: BK-trees over shards of fingerprints that can hold close pairs.

Fingerprints are cut into ``blocks`` bit blocks. Two fingerprints that differ in at most ``radius``
bits agree on at least ``blocks - radius`` whole blocks, so every close pair meets in the shard of
some choice of that many blocks. Each shard builds a BK-tree (children keyed by the Hamming distance
to their parent) and queries follow only edges within the radius. A shard answers with one link per
fingerprint to the smallest of its close group, never with all pairs, and links become components
by repeated minimum-neighbour contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of word shingles (XXH64, seed 42): a bit is set in over half the hashes."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, and only the six ASCII blanks separate
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    bytes_ = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(bytes_[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


#: Bits of each byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


FINGERPRINTS = "doc_id BIGINT, text_hash BIGINT, fp BIGINT"


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp) with the 64 bits as a signed BIGINT; null text is empty (fp 0)."""

    def run(batches):
        def one(batch):
            fps = np.array([fingerprint(t, shingle) for t in common.utf8(batch, "text")], dtype=np.uint64)
            return {"fp": fps.view(np.int64)}

        yield from common.per_batch(FINGERPRINTS, ["doc_id", "text_hash"], one)(batches)

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return d.mapInArrow(run, FINGERPRINTS)


class BKTree:
    """BK-trees over distinct 64-bit values, one for each shard, built and searched level by level.

    ``shard`` numbers the shards 0, 1, ... of values that stand shard by shard (default: one shard).
    Node k is the root of shard k. Children of a node stand together, ordered by their edge (the
    distance to the node), so the edges within a radius are one slice.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray | None = None):
        values = np.asarray(values, dtype=np.uint64)
        shard = np.zeros(len(values), dtype=np.int64) if shard is None else shard
        # groups of values below one node; the first of each group becomes the node
        roots = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(values)])
        keep = np.ones(len(values), dtype=bool)
        keep[roots] = False
        member, group, heads = np.flatnonzero(keep), shard[keep], roots
        nodes, edges, parents = [roots], [np.zeros(len(roots), dtype=np.int64)], [np.full(len(roots), -1)]
        base, count = 0, len(roots)
        while len(member):
            d = np.bitwise_count(values[member] ^ values[heads[group]]).astype(np.int64)
            key = group * 65 + d
            sort = np.argsort(key, kind="stable")
            member, key = member[sort], key[sort]
            lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            child = np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(key)]))
            nodes.append(member[lead])
            edges.append(key[lead] % 65)
            parents.append(base + key[lead] // 65)
            base, count = count, count + len(lead)
            heads = member[lead]
            keep = np.ones(len(member), dtype=bool)
            keep[lead] = False
            member, group = member[keep], child[keep]
        self.order = np.concatenate(nodes)
        self.values = values[self.order]
        self.edge = np.concatenate(edges)
        parent = np.concatenate(parents)
        self.slots = parent * 65 + self.edge  # ascending: nodes stand in order of (parent, edge)

    def near(self, queries: np.ndarray, radius: int, shard: np.ndarray | None = None, pairs: int = 1 << 21):
        """Yield (query index, value index) arrays of pairs within ``radius`` in the queries' shards.

        The frontier is split so that about ``pairs`` node visits are held at a time.
        """
        queries = np.asarray(queries, dtype=np.uint64)
        if not len(self.values) or not len(queries):
            return
        step = max(1, pairs // 64)
        root = np.zeros(len(queries), dtype=np.int64) if shard is None else shard
        work = [(np.arange(a, min(a + step, len(queries))), root[a : a + step]) for a in range(0, len(queries), step)]
        while work:
            q, n = work.pop()
            d = np.bitwise_count(queries[q] ^ self.values[n]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], self.order[n[hit]]
            lo = np.searchsorted(self.slots, n * 65 + np.maximum(d - radius, 1), "left")
            hi = np.searchsorted(self.slots, n * 65 + np.minimum(d + radius, 64), "right")
            size = hi - lo
            go = size > 0
            q, lo, size = q[go], lo[go], size[go]
            cut = np.searchsorted(np.cumsum(size), np.arange(pairs, size.sum() + pairs, pairs)) + 1 if len(size) else []
            a = 0
            for b in cut:
                b = min(int(b), len(size))
                if a < b:
                    s = size[a:b]
                    shift = np.repeat(lo[a:b] - np.r_[0, np.cumsum(s)[:-1]], s)
                    work.append((np.repeat(q[a:b], s), np.arange(s.sum()) + shift))
                    a = b


def components(values: np.ndarray, radius: int, shard: np.ndarray | None = None) -> np.ndarray:
    """For each value, the smallest index reachable by close pairs inside its shard."""
    label = np.arange(len(values))
    for q, v in BKTree(values, shard).near(values, radius, shard):
        a, b = label[q], label[v]
        while True:
            a, b = label[a], label[b]
            open_ = a != b
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jump = label[label]
                if (jump == label).all():
                    break
                label = jump
    return label


def shard_links(unique: DataFrame, radius: int, blocks: int, split: int) -> DataFrame:
    """(fp, other) links: in each shard, a fingerprint and the smallest of its close group there.

    A shard of more than ``split`` fingerprints is divided: its values are dealt over parts of
    that size, and every pair of parts is one task, so no task grows with a hot shard.
    """
    agree = blocks - radius
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(blocks), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    dealt = unique.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key")
    sizes = dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select("choice", "key", F.ceil(F.col("n") / split).cast("int").alias("parts"))
    placed = dealt.join(parts, ["choice", "key"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # part p goes to the tasks (p, q) and (q, p) of every q
    spread = placed.select(
        "choice", "key", "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("mine")).alias("a"), F.greatest(q, F.col("mine")).alias("b")))).alias("t"),
    ).select("choice", "key", "t.a", "t.b", "fp")
    spread = spread.repartition("choice", "key", "a", "b").sortWithinPartitions("choice", "key", "a", "b", "fp")
    schema = pa.schema([("fp", pa.int64()), ("other", pa.int64())])

    def run(batches):
        columns = ["choice", "key", "a", "b", "fp"]

        def solve(rows):
            change = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in columns[:-1]])
            shard = np.cumsum(np.r_[0, change])
            fps = rows["fp"]
            label = components(fps.view(np.uint64), radius, shard)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[label[moved]])], schema=schema)

        held = {c: np.empty(0, dtype=np.int64) for c in columns}
        for batch in batches:
            held = {c: np.concatenate([held[c], batch.column(c).to_numpy(zero_copy_only=False)]) for c in columns}
            # the last shard may go on in the next batch
            same = np.logical_and.reduce([held[c] == held[c][-1] for c in columns[:-1]])
            whole = len(same) - int(same.sum())
            if whole:
                yield solve({c: v[:whole] for c, v in held.items()})
                held = {c: v[whole:] for c, v in held.items()}
        if len(held["fp"]):
            yield solve(held)

    return spread.mapInArrow(run, "fp BIGINT, other BIGINT").distinct()


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """(fp, root): the smallest value of each component of ``links`` (fp, other).

    Alternates large-star and small-star contraction; each round's edges are written to the shared
    folder. No row gathers a component: a star is as many rows as it has members.
    """
    edges = common.stored(
        links.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v")).where("u <> v").distinct(), name
    )
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = common.stored(small.where("u <> v").distinct(), name)
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same == new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            return new.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        edges = new


def near_duplicates(docs: DataFrame, shingle: int, radius: int, blocks: int | None = None, split: int = 20_000) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most
    ``radius`` bits (itself included). Null text is empty; a null doc_id takes part, but names a
    component only if no other id does. Repeated rows are kept. ``blocks`` (default radius + 2)
    sets the shards: more blocks, more but smaller shards. ``root`` is the component's smallest
    fingerprint.
    """
    held = common.stored(fingerprints(docs, shingle), "simhash")
    unique = common.stored(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-unique")
    links = shard_links(unique.select("fp"), radius, blocks or radius + 2, split)
    roots = common.stored(connected(links), "simhash-roots")
    least = unique.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = least.join(named, "root").select("fp", "root", "component_id")
    return held.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with its own columns.

    The row of the smallest doc_id stays (a null id only if the group has no other; of several rows
    of that id, the one of the smallest text hash, once). Rows are found again by id and text hash.
    """
    near = near_duplicates(docs, shingle, radius)
    one = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first"))
    chosen = one.select(F.col("first.doc_id").alias("chosen_id"), F.col("first.text_hash").alias("chosen_hash"))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = kept.join(chosen, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("chosen_id")) & (F.xxhash64("row.text") == F.col("chosen_hash")))
    return found.groupBy("chosen_id", "chosen_hash").agg(F.first("row").alias("row")).select("row.*")


def op7_simhash_bk(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (4-word shingles, at most 4 differing bits)."""
    near = near_duplicates(common.table(spark, sf_dir, "documents"), 4, 4)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
