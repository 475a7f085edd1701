"""The prefix trie against a plain dictionary of prefixes, and its encoding against a stack."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rateflow.llm import trie

SF = "/root/testdata/sf0.01"
TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def originals(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}


def rebuilt(conv):
    out = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = conv.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute(paths):
    """{(smallest member, depth): ...} rows of every prefix."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    below, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[q][0] for q in kids[p]) if kids.get(p) else 1
        saved = sum(below[q][1] for q in kids.get(p, ())) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        below[p] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(kids.get(p, ())), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def of(nodes):
    none = hashlib.sha256().hexdigest()
    return sorted(
        ((r["least"], r["depth"], r["parent_least"], r["n"], r["kids"], r["leaves"], r["saved"], bytes(r["ends"]).hex() if r["ends"] is not None else none) for r in nodes.collect()),
        key=str,
    )


def given(spark, paths):
    """(conv_id, turns) of plain paths."""
    rows = [(c, [(hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), len(x.encode())) for r, x in p]) for c, p in paths.items()]
    return spark.createDataFrame(rows, "conv_id BIGINT, turns ARRAY<STRUCT<digest: BINARY, size: BIGINT>>")


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 64, 65, 500, 40_000])
def test_findclose_on_random_trees(n):
    rng = np.random.default_rng(n)
    bits, depth, left = [1], 1, n - 1
    while left or depth > 1:
        if left and (depth == 1 or rng.random() < 0.5 + 0.2 * math.sin(len(bits) / 300)):
            bits.append(1)
            depth, left = depth + 1, left - 1
        else:
            bits.append(0)
            depth -= 1
    bits.append(0)
    stack, close = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    opens = np.flatnonzero(bits)
    assert trie.Parentheses(np.array(bits, dtype=np.uint8)).findclose(opens).tolist() == [close[i] for i in opens.tolist()]


def test_findclose_of_deep_and_flat_trees():
    for n in (100, 5000):
        deep = np.r_[np.ones(n), np.zeros(n)].astype(np.uint8)
        assert trie.Parentheses(deep).findclose(np.arange(n)).tolist() == list(range(2 * n - 1, n - 1, -1))
        flat = np.r_[1, np.tile([1, 0], n), 0].astype(np.uint8)
        assert trie.Parentheses(flat).findclose(np.r_[0, np.arange(1, 2 * n, 2)]).tolist() == [2 * n + 1, *range(2, 2 * n + 1, 2)]


def random_paths(seed, n=400):
    rng = np.random.default_rng(seed)
    paths = {}
    for c in range(n):
        if c and rng.random() < 0.3:  # copies and extensions
            p = list(paths[int(rng.integers(c)) * 7 - 300])
            p = p[: int(rng.integers(len(p) + 1))] + [("u", str(x)) for x in rng.integers(0, 3, rng.integers(0, 3))]
        else:
            p = [("a" * int(rng.integers(2)), "é" * int(x)) for x in rng.integers(0, 4, rng.integers(0, 7))]
        paths[c * 7 - 300] = p
    for c in range(150):
        paths[10_000 + c] = [("hot", "start")] + ([("x", str(c % 9))] if c % 2 else [])
    paths[20_000] = [("deep", str(i)) for i in range(300)]
    paths[20_001] = [("deep", str(i)) for i in range(250)] + [("end", "")]
    return paths


@pytest.mark.parametrize(("shard_nodes", "fan_in"), [(1 << 17, 64), (1, 2), (5, 3), (40, 2)])
def test_shards_and_merged_spines(spark, shard_nodes, fan_in):
    paths = random_paths(shard_nodes)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = of(trie.trie(given(spark, paths), shard_nodes, fan_in))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(paths)


def test_ends_of_many_copies_run_over_pieces(spark):
    ids = list(range(-50, 3000))
    paths = spark.createDataFrame([(i, b"s" if i % 3 else b"t") for i in ids], "conv_id BIGINT, seq BINARY")
    for piece in (7, 1 << 16):
        got = {bytes(r["seq"]): (r["least"], r["n"], bytes(r["ends"]).hex()) for r in trie.ends_of(paths, piece).collect()}
        for seq, keep in ((b"s", [i for i in ids if i % 3]), (b"t", [i for i in ids if not i % 3])):
            assert got[seq] == (keep[0], len(keep), hashlib.sha256(",".join(map(str, keep)).encode()).hexdigest())


def test_rebuilding_with_nulls_ties_and_missing_bases(spark):
    rows = []
    for c in [*range(0, 60), -7, -5, 103, 104, 2**40 + 3]:  # 103 and 104 have no base
        if c in (20, 36):
            continue
        for t in range(c % 12 + 1):
            rows.append((c, t if t != 3 else None, None if t % 5 == 4 else "r", None if t == 6 else f"{c % 5 if t else 0} {t}"))
        if c % 7 == 0:
            rows += [(c, 1, "r", "tie"), (c, 1, "q", "tie"), (c, 0, "r", "0 0"), (c, None, None, None)]
    rows += [(None, 0, "r", "x"), (200, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", digest STRING, size INT")
    paths = rebuilt(originals(rows))
    got = {r["conv_id"]: [(bytes(t["digest"]).hex(), t["size"]) for t in r["turns"]] for r in trie.rebuilt(trie.paths_of(df)).collect()}
    assert got == {c: [(hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), len(x.encode())) for r, x in p] for c, p in paths.items()}
    assert any(not p for p in paths.values())  # a turnless one
    assert of(trie.trie(trie.rebuilt(trie.paths_of(df)))) == brute(paths)


def test_long_texts_and_empty_table(spark):
    rows = [(c, t, "u", "x" * 200_000 * (t + 1)) for c in (5, 6, 10) for t in range(3)]
    df = spark.createDataFrame(rows, TURNS)
    assert of(trie.trie(trie.rebuilt(trie.paths_of(df)))) == brute(rebuilt(originals(rows)))
    assert trie.trie(trie.rebuilt(trie.paths_of(df.limit(0)))).collect() == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = [tuple(r) for r in trie.op11_prefix_trie(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(con.execute(trie.ORACLE).fetchall(), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*[F.col(c) for c in ("conv_id", "turn", "role", "text")]).collect()]
    assert sorted(got, key=str) == brute(rebuilt(originals(rows)))
