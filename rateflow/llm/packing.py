"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are cut into whole sequences and one remainder. The histogram of remainder lengths (at
most ``size`` - 1 rows, however large the corpus) is the demand of a cutting-stock linear program:
a knapsack dynamic program prices new patterns until the program is within ``gap`` of its lower
bound. Rounded-down patterns, and patterns for what rounding leaves, are then assigned to documents
by their rank among the documents of equal remainder length. A pattern that stays short by more
than ``slack`` ids is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateflow.llm import common, tokens

Pattern = dict[int, int]


def _fill(pattern: Pattern) -> int:
    return sum(n * k for n, k in pattern.items())


def first_fit(demand: dict[int, float], size: int, whole: bool) -> list[tuple[Pattern, float]]:
    """Largest-first patterns, each used until a length of it is exhausted.

    ``whole``: pattern and use counts are integers that the demand covers. Otherwise every pattern
    exhausts exactly one new length first, so the patterns form a triangular basis.
    """
    left = {n: c for n, c in demand.items() if c > 0}
    out = []
    while left:
        lengths = np.array(sorted(left))
        pattern, room = {}, size
        k = len(lengths)
        while k:
            k = min(k, int(np.searchsorted(lengths, room, "right")))
            if not k:
                break
            n = int(lengths[k - 1])
            times = room // n
            if whole:
                times = min(times, int(left[n]))
            pattern[n] = times
            room -= n * times
            k -= 1
        used = min(left[n] / t for n, t in pattern.items())
        if whole:
            used = int(used)
        out.append((pattern, used))
        done = min(pattern, key=lambda n: left[n] / pattern[n])
        for n, t in pattern.items():
            left[n] -= used * t
            if left[n] < 1e-9 and (whole or n == done):
                del left[n]
    return out


def price(lengths: np.ndarray, duals: np.ndarray, size: int) -> tuple[float, Pattern]:
    """The pattern of greatest dual value: unbounded knapsack by dynamic programming."""
    best = np.zeros(size + 1)
    take = np.full(size + 1, -1)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            values = best[c - lengths[:k]] + duals[:k]
            i = int(values.argmax())
            if values[i] > best[c] + 1e-12:
                best[c], take[c] = values[i], i
    pattern, c = defaultdict(int), size
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[int(lengths[take[c]])] += 1
            c -= int(lengths[take[c]])
    return float(best[size]), dict(pattern)


def solve(demand: dict[int, int], size: int, gap: float = 2e-3) -> list[tuple[Pattern, float]]:
    """Patterns with fractional use counts that meet ``demand``, within ``gap`` of the optimum.

    Revised simplex with column generation, started from the triangular largest-first basis. Ends
    when the value is within ``gap`` of the larger of two lower bounds (ids over ``size``; value
    over the best price) or no pattern prices out.
    """
    lengths = np.array(sorted(demand))
    want = np.array([demand[int(n)] for n in lengths], dtype=float)
    m = len(lengths)
    if not m:
        return []
    at = {int(n): i for i, n in enumerate(lengths)}

    def column(p: Pattern) -> np.ndarray:
        a = np.zeros(m)
        for n, k in p.items():
            a[at[n]] = k
        return a

    basis = [p for p, _ in first_fit({n: float(c) for n, c in demand.items()}, size, False)]
    inverse = np.linalg.inv(np.column_stack([column(p) for p in basis]))
    uses = np.maximum(inverse @ want, 0.0)
    area = float(lengths @ want) / size
    bound, steps = area, 0
    while uses.sum() > (1 + gap) * bound and np.ceil(uses.sum() - 1e-9) > np.ceil(bound - 1e-9):
        duals = inverse.sum(axis=0)
        value, pattern = price(lengths, np.maximum(duals, 0.0), size)
        bound = max(bound, float(np.maximum(duals, 0.0) @ want) / max(value, 1.0))
        if value <= 1 + 1e-9:
            break
        a = column(pattern)
        way = inverse @ a
        ratio = np.where(way > 1e-9, uses / np.where(way > 1e-9, way, 1.0), np.inf)
        row = int(ratio.argmin())
        if not np.isfinite(ratio[row]):
            break
        uses = np.maximum(uses - ratio[row] * way, 0.0)
        uses[row] = ratio[row]
        pivot = inverse[row] / way[row]
        inverse -= np.outer(way, pivot)
        inverse[row] = pivot
        basis[row] = pattern
        steps += 1
        if steps % 500 == 0:  # rounding errors grow with the updates
            inverse = np.linalg.inv(np.column_stack([column(p) for p in basis]))
            uses = np.maximum(inverse @ want, 0.0)
    return list(zip(basis, uses.tolist(), strict=True))


def rounded(demand: dict[int, int], size: int, gap: float = 2e-3) -> list[tuple[Pattern, int]]:
    """Patterns with whole use counts that meet ``demand`` exactly.

    The fractional counts are rounded down; what is left (less than one use of each pattern of the
    basis) is packed largest first.
    """
    left = dict(demand)
    out = []
    for pattern, used in sorted(solve(demand, size, gap), key=lambda x: -x[1]):
        n = min([int(used + 1e-6), *(left[k] // t for k, t in pattern.items())])
        if n > 0:
            out.append((pattern, n))
            for k, t in pattern.items():
                left[k] -= n * t
    return out + [(p, int(n)) for p, n in first_fit(left, size, True)]


def binary_cuts(fill: int, size: int, slack: int) -> list[int]:
    """Sequence lengths for a pattern of ``fill`` ids: itself if nearly full, else powers of two."""
    if size - fill <= slack or fill & (fill - 1) == 0:
        return [fill]
    return [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]


class Plan:
    """Where the remainder of rank k among those of a length goes."""

    def __init__(self, demand: dict[int, int], size: int, first_sequence: int, gap: float = 2e-3, slack: int = 4):
        self.ranks: dict[int, list[int]] = defaultdict(list)
        self.uses: dict[int, list[tuple]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        sequence = first_sequence
        for pattern, used in rounded(demand, size, gap):
            parts = binary_cuts(_fill(pattern), size, slack)
            ends = np.cumsum(parts).tolist()
            at = 0
            for n in sorted(pattern, reverse=True):
                slots = []
                for _ in range(pattern[n]):
                    slots.append(self._cut(at, n, ends, parts))
                    at += n
                self.ranks[n].append(taken[n])
                self.uses[n].append((sequence, len(parts), slots))
                taken[n] += used * pattern[n]
            sequence += used * len(parts)
        self.sequences = sequence

    @staticmethod
    def _cut(at: int, n: int, ends: list[int], parts: list[int]) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, part, offset in the part) of ids at ``at`` .. ``at + n``."""
        out = []
        for k, (end, part) in enumerate(zip(ends, parts, strict=True)):
            a, b = max(at, end - part), min(at + n, end)
            if a < b:
                out.append((a - at, b - a, k, a - end + part))
        return out

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) pieces of one remainder."""
        ranks = self.ranks[length]
        k = int(np.searchsorted(ranks, rank, "right")) - 1
        first, parts, slots = self.uses[length][k]
        instance, slot = divmod(rank - ranks[k], len(slots))
        return [(s, n, first + instance * parts + part, o) for s, n, part, o in slots[slot]]


ENCODED = "doc_id BIGINT, doc_tokens BIGINT, ids BINARY"


def encoded(docs: DataFrame, tokenizer: str, cut: str | None, end_id: int) -> DataFrame:
    """(doc_id, doc_tokens, ids) with the end id; two bytes an id where that suffices, else four."""

    def run(batches):
        enc = tokens.encoder(tokenizer, cut)
        end = np.array([end_id], dtype="<u4").tobytes()

        def one(batch):
            ids = [np.frombuffer(enc.encode(t) + end, dtype="<u4") for t in common.strings(batch, "text")]
            held = [(i.astype("<u2") if i.max() < 65536 else i).tobytes() for i in ids]
            return {"doc_tokens": [len(i) for i in ids], "ids": held}

        yield from common.per_batch(ENCODED, ["doc_id"], one)(batches)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ENCODED)


PIECES = "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"


def pack(docs: DataFrame, tokenizer: str, cut: str | None, end_id: int, size: int = 2048, group_rows: int = 20_000, gap: float = 2e-3, slack: int = 4, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each id in exactly one piece of one sequence of at most ``size``.

    Null text counts as empty (one end id). Repeated rows are documents of their own, and a very long
    text is as many whole sequences and a remainder. The ids are written once, with a row number.
    Ranks are counted within (remainder length, salt), the salt from the row number, so neither a
    length nor a doc_id that a third of all documents share is one group: a length has as many salts
    as its count holds ``group_rows``. Their offsets are rows of (rest, salt), joined by that key.
    ``with_ids`` adds the ids of each piece as little-endian uint32.
    """
    spark = docs.sparkSession
    numbered = encoded(docs, tokenizer, cut, end_id).withColumn("row", F.monotonically_increasing_id())
    held = common.stored(numbered, "packing-ids")  # the row number is fixed once it is written
    keyed = held.withColumns({"rest": F.col("doc_tokens") % size, "whole": (F.col("doc_tokens") / size).cast("bigint")})
    lengths = keyed.groupBy("rest").agg(F.count("*").alias("n"), F.sum("whole").alias("w")).orderBy("rest").collect()  # at most `size` rows
    first, total = {}, 0
    for r in lengths:
        first[r["rest"]], total = total, total + r["w"]
    plan = Plan({r["rest"]: r["n"] for r in lengths if r["rest"]}, size, total, gap, slack)

    salts = [1] * size
    for r in lengths:
        salts[r["rest"]] = -(-r["n"] // group_rows)
    of_rest = F.split(F.lit(",".join(map(str, salts))), ",").cast("array<bigint>")  # one literal when the plan is optimised
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row"), F.get(of_rest, F.col("rest").cast("int"))))
    groups = common.stored(
        keyed.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("whole").alias("w")), "packing-groups"
    )
    earlier = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        "rest", "salt",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("whole_before"),
    )
    order = Window.partitionBy("rest", "salt").orderBy("row")
    ranked = keyed.select(
        "*", (F.row_number().over(order) - 1).alias("rank"),
        F.coalesce(F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cum"),
    )
    placed = ranked.join(offsets, ["rest", "salt"]).select(
        "doc_id", "doc_tokens", "ids", "rest", "whole",
        (F.col("rank") + F.col("rank_before")).alias("rank"),
        (F.col("cum") + F.col("whole_before")).alias("cum"),
    )
    shared = spark.sparkContext.broadcast((plan, first))
    out = PIECES + (", ids BINARY" if with_ids else "")

    def cut_up(batches):
        plan, first = shared.value
        schema = common.arrow_schema(out)
        for batch in batches:
            rows = [[] for _ in schema]
            for r in batch.to_pylist():
                n = r["doc_tokens"]
                ids = memoryview(np.frombuffer(r["ids"], dtype="<u2" if len(r["ids"]) == 2 * n else "<u4").astype("<u4").tobytes())
                base = first[r["rest"]] + r["cum"]
                parts = [(k * size, size, base + k, 0) for k in range(r["whole"])]
                if r["rest"]:
                    end = r["whole"] * size
                    parts += [(end + s, m, q, o) for s, m, q, o in plan.place(r["rest"], r["rank"])]
                for s, m, q, o in parts:
                    data = ids[4 * s : 4 * (s + m)]
                    row = [r["doc_id"], s, m, zlib.crc32(data), n, q, o]
                    for column, value in zip(rows, [*row, bytes(data)] if with_ids else row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return placed.mapInArrow(cut_up, out)


def op9_cutting_stock(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 with the byte-level tokenizer, end id 1."""
    return pack(common.table(spark, sf_dir, "documents"), "byte_bpe_50k.json", tokens.BLANKS, 1)
