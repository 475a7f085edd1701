"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a re-parameterised question keeps its
template. Windows of template words of every document are hash-joined with the windows of the
benchmark, which is broadcast in blocks of bounded size; the matches of a document and an item must
cover enough of the item and fill its slots consistently (one value of the item, one value of the
document) before the pair is reported; matches beside a copy's place do not count against it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common, rows

#: Unit words that follow a number.
UNITS = frozenset(
    "m km cm mm mi mile miles ft foot feet inch inches yard yards g kg mg lb lbs pound pounds ounce ounces ton tons l ml "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent % dollar dollars euro euros cent cents usd eur gbp degree degrees km/h mph".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())

_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,/:]*(?:st|nd|rd|th|%)?$")
_PARTS = re.compile("[-'’]")
_EDGE = "\"'()[]{}<>.,;:!?|*#$%&-–—…“”‘’«»¡¿"

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_PLACEHOLDER = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Words:
    """Raw word -> (hash of the lower-cased bare word, is capitalised, is number, is unit, ends a
    sentence, may be a name), through a bounded cache."""

    def __init__(self, limit: int = 700_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def code(self, raw: str) -> int:
        """58-bit hash and flags in one integer: 1 capital, 2 number, 4 unit, 8 sentence end, 16 capital
        with a possessive, hyphen or apostrophe allowed. The hash is that of the word less a possessive
        "'s", then two bits for its form."""
        plain = raw.isalpha()  # no mark, digit or possessive
        bare = raw if plain else raw.strip(_EDGE)
        if not bare:  # marks only: dropped from the word sequence
            return -2
        low = bare.lower()
        possessive = 0 if plain else 1 if low.endswith("'s") else 2 if low.endswith("’s") else 0
        h = xxhash.xxh64_intdigest((low[:-2] if possessive else low).encode())
        number = low in NUMBER_WORDS or (not plain and bool(_NUMBER.match(bare)))
        capital = wide = False
        if not number and bare[0].isupper() and not bare.isupper():
            capital = plain or bare.isalpha()
        stem = bare[:-2] if possessive else bare
        if not number and stem[:1].isupper() and not stem.isupper():
            wide = capital or all(map(str.isalpha, _PARTS.split(stem)))
        ends = not plain and raw.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":")
        flags = capital | number << 1 | (low in UNITS) << 2 | ends << 3 | wide << 4
        return ((h & ((1 << 56) - 1)) << 2 | possessive) << 5 | flags

    def codes(self, text: str) -> np.ndarray:
        words = text.replace("\n", " . ").split()
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            for i, c in enumerate(out):
                if c is None:
                    c = self.code(words[i])
                    if len(known) < self.limit:
                        known[words[i]] = c
                    out[i] = c
        return np.array(out, dtype=np.int64)


_WORDS = Words()  # a Python worker's own


def _counts(mask: np.ndarray, width: int) -> np.ndarray:
    """How many of each ``width`` neighbours are true."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[width:] - sums[:-width]


class Sequence:
    """The template of a text: typed placeholders for slots, hashes for other words.

    A capitalised word is a name unless it opens a sentence; a unit word counts after a number. In the
    wide reading capitalised words that open a sentence, and names with a possessive, a hyphen or an
    apostrophe, are names too; "Tom's" has the value of "Tom" there.
    """

    def __init__(self, codes: np.ndarray):
        real = codes >= 0
        ends = np.where(real, codes >> 3 & 1, 1).astype(bool)
        # a word opens a sentence if the word or mark before it ended one
        opens = np.concatenate(([True], ends[:-1]))[real] if len(codes) else np.empty(0, dtype=bool)
        codes = codes[real]
        self.value = (codes >> 5).astype(np.uint64)
        number = (codes & 2) > 0
        unit = ((codes & 4) > 0) & np.concatenate(([False], number[:-1])) if len(codes) else number
        name = ((codes & 1) > 0) & ~opens
        self.type = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL))).astype(np.int8)
        self.token = np.where(self.type == LITERAL, self.value, _PLACEHOLDER[self.type])
        self.wide = (self.type == LITERAL) & ((codes & 16) > 0)
        self.wide_type = np.where(self.wide, NAME, self.type).astype(np.int8)

    def __len__(self) -> int:
        return len(self.value)

    def windows(self, width: int, literals: int = 2, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, template hashes, hashes as written) of the windows (``at``: those places only).

        A window with fewer than ``literals`` ordinary words says nothing as a template and has the
        second hash for both; that one also finds copies whose case or punctuation moved names and
        sentences."""
        at = np.arange(max(0, len(self) - width + 1)) if at is None else at
        typed, plain = self._hash(self.token, at, width, 29), self._hash(self.value, at, width, 31, 1)
        if not len(at):
            return at, typed, plain
        return at, np.where(_counts(self.type == LITERAL, width)[at] >= literals, typed, plain), plain

    def wide_windows(self, width: int, literals: int = 2, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows that the wide reading changes, with enough ordinary words."""
        n = len(self) - width + 1
        if n <= 0 or not self.wide.any():
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        good = (_counts(self.wide, width) > 0) & (_counts(self.wide_type == LITERAL, width) >= literals)
        at = np.flatnonzero(good) if at is None else at[good[at]]
        token = np.where(self.wide, _PLACEHOLDER[NAME], self.token)
        return at, self._hash(token, at, width, 29)

    def neighbours(self) -> list[np.ndarray]:
        """20 bits of each pair of neighbours: as a template, as written, and in the wide reading."""
        readings = [self.token, self.value]
        if self.wide.any():
            readings.append(np.where(self.wide, _PLACEHOLDER[NAME], self.token))
        return [((r[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ r[1:] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64) for r in readings]

    @staticmethod
    def _hash(token: np.ndarray, at: np.ndarray, width: int, shift: int, start: int = 0) -> np.ndarray:
        h, base = np.full(len(at), start, np.uint64), np.uint64(0x100000001B3)
        for k in range(width):
            h = (h ^ token[at + k]) * base
            h ^= h >> np.uint64(shift)
        return h

    def shape(self) -> tuple:
        """What items of one template share: both readings, and which slots are filled alike."""
        first: dict[tuple[int, int], int] = {}
        slots = np.flatnonzero((self.type != LITERAL) | self.wide)
        alike = [first.setdefault((int(self.value[i]), int(self.value[i]) >> 2), i) for i in slots.tolist()]
        stems: dict[int, int] = {}
        near = [stems.setdefault(int(self.value[i]) >> 2, i) for i in slots.tolist()]
        token = np.where(self.wide, _PLACEHOLDER[NAME], self.token)
        literal = np.where((self.type == LITERAL) & ~self.wide, self.value, 0)
        return self.token[~self.wide].tobytes(), token.tobytes(), literal.tobytes(), self.type.tobytes(), self.wide.tobytes(), tuple(alike), tuple(near)


def consistent(item: Sequence, doc: Sequence, at: list[tuple[int, int]], wide: bool = False) -> tuple[float, int]:
    """Share of the matched slots that follow the main mapping of item values to document values
    (and back), and the number of slots; 1.0 where no slot is matched. ``wide`` takes the slots of
    the wide reading."""
    kinds, others = (item.wide_type, doc.wide_type) if wide else (item.type, doc.type)
    less = 2 if wide else 0
    slots = [(int(kinds[q]), int(item.value[q]) >> less, int(doc.value[p]) >> less) for q, p in at if kinds[q] != LITERAL and others[p] == kinds[q]]
    if not slots:
        return 1.0, 0
    there, back = defaultdict(Counter), defaultdict(Counter)
    for kind, a, b in slots:
        there[kind, a][b] += 1
        back[kind, b][a] += 1
    good = sum(1 for kind, a, b in slots if there[kind, a].most_common(1)[0][0] == b and back[kind, b].most_common(1)[0][0] == a)
    return good / len(slots), len(slots)


def _aligned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most pairs that rise in both places (a longest increasing subsequence)."""
    ends, last, before, pairs = [], [], [], sorted(pairs, key=lambda x: (x[0], -x[1]))
    for i, (_, p) in enumerate(pairs):
        k = bisect_left(ends, p)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [p], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


class Index:
    """Windows of a block of benchmark items, sorted by hash, for joining inside a task.

    Items of one ``Sequence.shape`` form a class: their windows stand once, and what a document
    says of the template is worked out once. Only windows as written around a slot belong to a
    single member.
    """

    def __init__(self, items: list[tuple[int, str]], width: int):
        words = Words()
        self.width = width
        self.members: list[list[tuple[int, Sequence]]] = []
        classes: dict[tuple, int] = {}
        hashes, owner, place, wide, member = [], [], [], [], []
        low = np.uint64((1 << 20) - 1)
        #: low bits of every pair of neighbours of an item, in each reading
        self.pairs = np.zeros(1 << 20, dtype=bool)
        for item_id, text in items:
            s = Sequence(words.codes(text))
            if not len(s):
                continue
            for p in s.neighbours():
                self.pairs[p] = True
            k = classes.setdefault(s.shape(), len(classes))
            new = k == len(self.members)
            if new:
                self.members.append([])
            w = min(width, len(s))
            at, typed, plain = s.windows(w)
            slots = _counts((s.type != LITERAL) | s.wide, w) > 0
            # as written: around a slot for this member, else for the class
            own = np.flatnonzero(slots)
            parts = [(plain[own], own, False, len(self.members[k]))]
            if new:
                rest = np.flatnonzero(~slots & (plain != typed))
                few = typed != plain
                typed_at = np.flatnonzero(few | ~slots)
                wide_at, more = s.wide_windows(w)
                parts += [(typed[typed_at], typed_at, False, -1), (plain[rest], rest, False, -1), (more, wide_at, True, -1)]
            for h, q, is_wide, m in parts:
                hashes.append(h)
                owner.append(np.full(len(h), k))
                place.append(q)
                wide.append(np.full(len(h), is_wide))
                member.append(np.full(len(h), m))
            self.members[k].append((item_id, s))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        joined = lambda parts, kind: np.concatenate(parts)[order].astype(kind) if parts else np.empty(0, kind)
        self.hash = h[order]
        self.owner, self.place = joined(owner, np.int64), joined(place, np.int64)
        self.wide, self.member = joined(wide, bool), joined(member, np.int64)
        # a first look at the low bits spares most windows the search
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hash & low).astype(np.int64)] = True
        self.short = sorted({len(m[0][1]) for m in self.members if len(m[0][1]) < width})

    def matches(self, doc: Sequence, share: float, run: int, agree: float) -> list[tuple[int, float, int, float, int]]:
        """(item, covered share, longest run, agreement, slots) of the items that ``doc`` holds."""
        low = np.uint64((1 << 20) - 1)
        # a window can only match where all its neighbours are those of some item
        able = np.zeros(max(0, len(doc) - 1), dtype=bool)
        for p in doc.neighbours():
            able |= self.pairs[p]
        # class -> member (-1: all) -> pairs; wider: what only the wide reading matches
        found: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        wider: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for width in [self.width, *self.short]:
            if len(doc) < width:
                continue
            at = np.flatnonzero(_counts(able, width - 1) == width - 1) if width > 1 else np.arange(len(doc))
            if not len(at):
                continue
            _, typed, plain = doc.windows(width, at=at)
            wide_at, wide = doc.wide_windows(width, at=at)
            for w, places, is_wide in ((typed, at, False), (plain, at, False), (wide, wide_at, True)):
                maybe = np.flatnonzero(self.seen[(w & low).astype(np.int64)])
                if not len(maybe):
                    continue
                lo = np.searchsorted(self.hash, w[maybe], "left")
                hi = np.searchsorted(self.hash, w[maybe], "right")
                for p, a, b in zip(places[maybe][hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    for k, q, v, m in zip(self.owner[a:b].tolist(), self.place[a:b].tolist(), self.wide[a:b].tolist(), self.member[a:b].tolist(), strict=True):
                        if min(self.width, len(self.members[k][0][1])) == width:
                            if is_wide or v:
                                wider[k].add((q, p))
                            else:
                                found[k][m].add((q, p))
        out = []
        for k in [*found, *(wider.keys() - found.keys())]:
            members, pairs, more = self.members[k], found.get(k, {}), wider.get(k, set())
            shared = pairs.get(-1, set())
            if len(members) == 1:
                best = self._either(members[0][1], doc, shared | pairs.get(0, set()), more, share, run, agree)
                out += [(members[0][0], *best)] if best else []
                continue
            best = self._either(members[0][1], doc, shared, more, share, run, agree, True)
            if best:
                out += [(item_id, *best) for item_id, _ in members]
                continue
            # a member may still be there as written
            for m in sorted(pairs.keys() - {-1}):
                best = self._either(members[m][1], doc, shared | pairs[m], more, share, run, agree)
                out += [(members[m][0], *best)] if best else []
        return out

    def _either(self, item: Sequence, doc: Sequence, pairs: set, more: set, share: float, run: int, agree: float, template: bool = False) -> tuple | None:
        best = self._best(item, doc, pairs, share, run, agree, False, template)
        return best or (self._best(item, doc, pairs | more, share, run, agree, True, template) if more else None)

    def _best(
        self, item: Sequence, doc: Sequence, pairs: set[tuple[int, int]], share: float, run: int, agree: float, wide: bool = False, template: bool = False
    ) -> tuple[float, int, float, int] | None:
        """(covered share, longest run, agreement, slots) of the best copy of ``item`` in ``doc``;
        with ``template`` its slot values say nothing, as it stands for its class."""
        width = min(self.width, len(item))
        total = len(item) - width + 1
        best = None

        def reach(part):
            covered = len({q for q, _ in part}) / total
            longest = self._longest(part) + width - 1 if part else 0
            return covered, longest, covered >= share or longest >= run

        # copies of the item in one document stand apart: group by the place of its start
        for group, near in self._copies(pairs, len(item)):
            if not reach(near)[2]:
                continue  # nor does any part of it
            for part in self._readings(group, near, item, doc, width, template):
                covered, longest, enough = reach(part)
                if not enough:
                    continue
                words = {(q + i, p + i) for q, p in part for i in range(width)}
                agreement, slots = consistent(item, doc, sorted(words), wide)
                if agreement >= agree:
                    if best is None or covered > best[0]:
                        best = (covered, longest, agreement, slots)
                    break
        return best

    @staticmethod
    def _readings(group: list[tuple[int, int]], near: list[tuple[int, int]], item: Sequence, doc: Sequence, width: int, template: bool) -> Iterator[list[tuple[int, int]]]:
        """The pairs that may be one copy, each set to be judged by itself: an item that repeats its
        own template also matches beside its place, and those matches say nothing of the slots. All
        pairs; those equal as written; the longest alignment in order; each diagonal."""
        yield group
        if not template:
            yield [(q, p) for q, p in near if np.array_equal(item.value[q : q + width], doc.value[p : p + width])]
        yield _aligned(near)
        for _, one in groupby(group, key=lambda x: x[1] - x[0]):
            yield list(one)

    @staticmethod
    def _copies(pairs: set[tuple[int, int]], length: int) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
        """Groups of pairs on diagonals close to each other, each with the pairs as close to its main diagonal."""
        pairs = sorted(pairs, key=lambda x: x[1] - x[0])
        at, reach = [p - q for q, p in pairs], max(5, length // 5)
        lo = 0
        while lo < len(pairs):
            hi = bisect_right(at, at[lo] + reach)
            main = Counter(at[lo:hi]).most_common(1)[0][0]
            yield pairs[lo:hi], pairs[bisect_left(at, main - reach) : bisect_right(at, main + reach)]
            lo = hi

    @staticmethod
    def _longest(group: list[tuple[int, int]]) -> int:
        """Most consecutive windows on one diagonal."""
        place = sorted({(p - q, p) for q, p in group})
        best = now = 1
        for (d1, p1), (d2, p2) in zip(place, place[1:], strict=False):
            now = now + 1 if d1 == d2 and p2 == p1 + 1 else 1
            best = max(best, now)
        return best


MATCHES = "items ARRAY<BIGINT>, shares ARRAY<DOUBLE>, runs ARRAY<BIGINT>, agreements ARRAY<DOUBLE>, slots ARRAY<BIGINT>"


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_chars`` characters of text (by hash of the item)."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_chars)
    if n <= 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.where(part == i) for i in range(n)]


def found_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, run: int = 13, agree: float = 0.8, block_chars: int = 16_000_000) -> DataFrame:
    """(row, items, shares, runs, agreements, slots): the benchmark items each row's text holds.

    A document holds an item if windows of ``width`` template words cover at least ``share`` of the
    item's windows near one place, or a run of ``run`` words, with slots filled consistently
    (``agree``). An item shorter than ``width`` is one window. Null and empty texts hold nothing;
    null or empty items and null item ids are skipped; repeated items are reported each. A benchmark
    above ``block_chars`` is joined block by block, each a pass over the documents.
    """
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    out = docs
    for i, block in enumerate(_blocks(items, block_chars)):
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in block.collect()], width))  # bounded by block_chars

        def one(batch, index=index):
            hits = [index.value.matches(Sequence(_WORDS.codes(t)), share, run, agree) if t else [] for t in common.strings(batch, "text")]
            names = [f.split(" ")[0] for f in MATCHES.split(", ")]
            return {n: [[m[k] for m in h] for h in hits] for k, n in enumerate(names)}

        if i == 0:
            out = rows.annotate(docs, {"text": F.col("text")}, MATCHES, one)
        else:  # each block is a pass of its own, not one more worker in every task
            out = common.stored(out, "leaks")
            more = rows.annotate(out, {"text": F.col("row.text")}, MATCHES, one)
            out = more.select("row.row", *[F.concat(f"row.{n}", n).alias(n) for n in ("items", "shares", "runs", "agreements", "slots")])
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark item, with their own columns."""
    return found_items(docs, benchmark).where(F.size("items") == 0).select("row.*")


def op5_template_leaks(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) pairs of all documents and the benchmark items they hold."""
    found = found_items(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    each = F.explode(F.arrays_zip("items", "shares", "runs", "agreements", "slots")).alias("m")
    return found.select(F.col("row.doc_id").alias("doc_id"), each).select(
        "doc_id", F.col("m.items").alias("item_id"), F.col("m.shares").alias("covered"), F.col("m.runs").alias("longest_run"),
        F.col("m.agreements").alias("slot_agreement"), F.col("m.slots").alias("slots"),
    )
