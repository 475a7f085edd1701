"""SpotSigs fingerprints: chains of content words after common-word anchors.

At each anchor (a very common word) a signature is the anchor and the next ``chain`` content words,
``step`` apart. A text's fingerprint is the set of its signatures; likeness is the Jaccard measure
of two sets. Near pairs are searched in partitions by set length: sets of likeness t differ in
length by a factor t at most, and their rarest signatures must meet, so only those are joined.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common

#: Very common words of the languages served; they anchor chains and are no content.
ANCHORS = frozenset(
    b"the of and a an to in is it that was for on as with by at from this be are "
    b"der die das und ein eine den dem des von zu mit ist im auf nicht sich "
    b"le la les de du des et un une que qui dans en pour par sur pas est "
    b"el los las y se no con una su del al lo por para es".split()
) | frozenset("für où à está más".encode().split())

_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"


class Words:
    """Raw word -> 63-bit hash of the bare lower-case word, with the lowest bit set for anchors."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def code(self, raw: bytes) -> int:
        bare = raw.strip(_EDGE) or raw
        return (zlib.crc32(bare) << 31 | zlib.crc32(bare, 0x3C6EF372)) << 1 & (1 << 62) - 1 | (bare in ANCHORS)

    def codes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
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


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def signatures(text: bytes, chain: int = 3, step: int = 1) -> np.ndarray:
    """Sorted distinct 32-bit signatures. A chain cut off by the end of the text keeps the words it
    has; a text without anchors has the one signature of all its words; an empty text has none."""
    codes = _WORDS.codes(text)
    if not len(codes):
        return np.empty(0, dtype=np.uint32)
    anchor = (codes & 1).astype(bool)
    words = codes.astype(np.uint64)
    if not anchor.any():
        h = np.zeros(1, np.uint64)
        place = np.arange(1, len(words) + 1, dtype=np.uint64)
        h += (words * (2 * place + np.uint64(1))).sum(dtype=np.uint64)
        return (_mix(h, np.uint64(len(words))) >> np.uint64(32)).astype(np.uint32)
    content = words[~anchor]
    at = np.flatnonzero(anchor)
    following = at - np.arange(len(at))  # content words before each anchor
    h = _mix(np.full(len(at), 0x51ED270B, np.uint64), words[at])
    for k in range(chain):
        i = following + k * step
        h = _mix(h, np.where(i < len(content), content[np.minimum(i, len(content) - 1)], np.uint64(0)) if len(content) else np.zeros(len(at), np.uint64))
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard measure of two sorted sets; 0 at once where lengths alone keep it below ``least``.

    Two empty sets are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common_ = int((both[1:] == both[:-1]).sum())
    return common_ / (len(both) - common_)


def text_form(sigs: np.ndarray) -> str:
    """A fingerprint as text: the signatures in order, eight hexadecimal digits each."""
    return sigs.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by as many first ones (or all) of
    ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _numbers(values: list[int]) -> Column:
    """A constant array of longs, folded to one literal when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(bounds: Column, size: int, x: Column) -> Column:
    """How many of ``size`` sorted ``bounds`` are less than ``x``, by binary search."""

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))
        left = F.struct(a["lo"].alias("lo"), mid.alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(F.get(bounds, mid) < x, right).otherwise(left)

    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(size.bit_length() + 1)), start, halve, lambda a: a["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, text, grp, extra): documents in ranges of doc_id, each range followed by a copy
    (``extra``) of the first document of the next range (after the last range: of the first).

    Range bounds, and the least id of each range, come from doc_id alone: two numbers a range, a few
    ranges a shuffle partition. ``ord`` orders null ids first; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    least_id = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least_id))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(d.agg(F.percentile_approx("ord", share, 10 * ranges)).first()[0] or []))
    own = _below(_numbers(bounds), len(bounds), F.col("ord")) if bounds else F.lit(0)
    firsts = d.select(own.alias("grp"), "ord").groupBy("grp").agg(F.min("ord").alias("least")).orderBy("grp").collect()  # one row a range
    least, before = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)  # no row looks up an empty range
    for i, r in enumerate(firsts):
        least[r["grp"]], before[r["grp"]] = r["least"], firsts[i - 1]["grp"]
    placed = d.select("*", own.alias("own"))
    is_first = F.get(_numbers(least), F.col("own")) == F.col("ord")
    at_home = F.struct(F.col("own").cast("bigint").alias("grp"), F.lit(False).alias("extra"))
    copied = F.struct(F.get(_numbers(before), F.col("own")).alias("grp"), F.lit(True).alias("extra"))
    spread = placed.select("doc_id", "ord", "text", F.explode(F.when(is_first, F.array(at_home, copied)).otherwise(F.array(at_home))).alias("way"))
    return spread.select("doc_id", "ord", "text", "way.grp", "way.extra")


COMPARED = (
    "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
)


def compared(docs: DataFrame, chain: int = 3, step: int = 1) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Null text is empty. The next document is the next row by (doc_id, text), after the last the
    first (a lone document is its own next); repeated rows count singly. Whole texts are shuffled
    once, by range, and a task holds two documents.
    """

    def run(batches):
        import hashlib

        schema = common.arrow_schema(COMPARED)
        out = [[] for _ in schema]
        held = None  # (group, doc_id, text, signatures) waiting for its next document
        for batch in batches:
            for key, text, grp, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "grp", "extra")), strict=True):
                if held is not None and held[0] != grp:
                    held = None
                if extra and held is None:
                    continue  # a further copy of a repeated first document
                sigs = signatures(text.encode(), chain, step)
                if held is not None:
                    _, own_key, own, own_sigs = held
                    new = edited(own, text)
                    new_sigs = signatures(new.encode(), chain, step)
                    row = [
                        own_key, len(own), hashlib.sha256(new.encode()).hexdigest(), text_form(own_sigs), text_form(new_sigs),
                        likeness(own_sigs, new_sigs), likeness(own_sigs, sigs),
                    ]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    if len(out[0]) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                        out = [[] for _ in schema]
                held = None if extra else (grp, key, text, sigs)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    dealt = with_next(docs).repartition("grp").sortWithinPartitions("grp", "extra", "ord", "text")
    return dealt.select("doc_id", "text", "grp", "extra").mapInArrow(run, COMPARED)


def near_texts(docs: DataFrame, least: float = 0.8, chain: int = 3, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """(membership, links) of near-duplicate texts: likeness of at least ``least``.

    membership: doc_id, class_id (smallest doc_id with an equal fingerprint). links: class_a,
    class_b, likeness, for classes of different fingerprints. Copies meet once, as their class.
    Sets are partitioned by length so that only neighbouring partitions can be near, and joined on
    their rarest signatures: two sets of likeness t share one of their (1 - t) n + 1 rarest. Empty
    fingerprints (texts without words) form one class and link to none.
    """

    def run(batches):
        def one(batch):
            return {"sigs": [signatures(t, chain, step).astype("<u4").tobytes() for t in common.utf8(batch, "text")]}

        yield from common.per_batch("doc_id BIGINT, sigs BINARY", ["doc_id"], one)(batches)

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id BIGINT, sigs BINARY")
    held = common.stored(made, "spotsigs")
    classes = common.stored(held.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "spotsigs-classes")
    membership = held.join(classes, "sigs").select("doc_id", "class_id")
    n = (F.length("sigs") / 4).cast("int")
    width = F.floor(F.log(n) / -np.log(least)).cast("int")
    each = classes.where("length(sigs) > 0").select(
        "class_id", n.alias("n"), width.alias("part"),
        F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("sigs", i * 4 + 1, F.lit(4)))).alias("sig"),
    )
    rarity = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, "sig").groupBy("class_id", "n", "part").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by"))
    keys = ranked.select(
        "class_id", "n", "part",
        F.explode(F.transform(F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1), lambda x: x["sig"])).alias("sig"),
    )
    left = keys.select(F.col("class_id").alias("class_a"), F.col("n").alias("n_a"), F.col("part").alias("p"), "sig")
    right = keys.select(F.col("class_id").alias("class_b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("p"), "sig")
    # a: the shorter set (equal lengths: the smaller id); b lies in its partition or the one above
    pairs = left.join(right, ["p", "sig"]).where(
        "(n_a < n_b OR (n_a = n_b AND class_a < class_b)) AND n_a >= n_b * " + repr(least)
    ).select("class_a", "class_b").distinct()

    sides = pairs.join(classes.select(F.col("class_id").alias("class_a"), F.col("sigs").alias("a")), "class_a").join(
        classes.select(F.col("class_id").alias("class_b"), F.col("sigs").alias("b")), "class_b"
    )
    schema = pa.schema([("class_a", pa.int64()), ("class_b", pa.int64()), ("likeness", pa.float64())])

    def verify(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u4") for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            alike = np.array([likeness(x, y, least) for x, y in zip(a, b, strict=True)])
            t = pa.RecordBatch.from_arrays([batch.column("class_a"), batch.column("class_b"), pa.array(alike, pa.float64())], schema=schema)
            yield t.filter(pa.array(alike >= least))

    links = sides.select("class_a", "class_b", "a", "b").mapInArrow(verify, "class_a BIGINT, class_b BIGINT, likeness DOUBLE")
    return membership, links


def op1_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts (columns as in ``compared``)."""
    return compared(common.table(spark, sf_dir, "documents"))
