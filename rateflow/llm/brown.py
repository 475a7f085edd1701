"""Class-based n-gram scoring (Brown): exchange clustering of words, then P(class | class before)
times P(word | class).

Texts are turned into blocks of token indices over the block's own word list once. Word counts are
summed over all blocks by a shuffle of (block, word) rows and go back to the blocks, so no task
and no driver holds the vocabulary. Classes are learned by exchange for items: every word with at
least 1 in ``1 / frequent`` of all tokens is an item of its own, any other word belongs to the item
of its ending; so the number of items is bounded, their bigram counts cover every token of the
corpus, and an unseen word has a class too. Every further word with at least 1 in ``1 / own`` of all
tokens then moves to the class that its own counts of classes before and after it make most likely,
once for each of ``rounds`` passes. Rarer words stay with their ending: their context counts would
be as many rows as the corpus has word places.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateflow.llm import common

_CLOSING = b".,;:!?\"')]}|#$%&*"


def ending(word: bytes, endings: int) -> int:
    """The ending class of a word: its last three bytes before closing marks, and the last mark."""
    bare = word.rstrip(_CLOSING)
    return zlib.crc32(bare[-3:] + b"\0" + word[len(bare):][-1:]) % endings


def _squeeze(ids: np.ndarray) -> bytes:
    """Small integers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _expand(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


BLOCKS = "block BIGINT, doc_ids ARRAY<BIGINT>, held_out ARRAY<BOOLEAN>, lengths ARRAY<BIGINT>, ids BINARY, train_tokens BIGINT, words ARRAY<BINARY>, counts ARRAY<BIGINT>, endings ARRAY<INT>"


def blocks(docs: DataFrame, endings: int, block_tokens: int = 2_000_000) -> DataFrame:
    """Rows of about ``block_tokens`` tokens; index 0 of a block's word list is the end of a text.

    ``docs`` has doc_id, text (null: empty) and held_out; counts are of texts not held out.
    """

    def run(batches):
        schema = common.arrow_schema(BLOCKS)
        part, no = TaskContext.get().partitionId(), 0
        seen: dict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__
        seen[b""] = 0
        keys, held, ids = [], [], []
        count = 0

        def flush():
            lengths = np.array([len(i) for i in ids])
            every = np.concatenate(ids)
            train = np.repeat(~np.array(held), lengths)
            counts = np.bincount(every[train], minlength=len(seen))
            words = list(seen)
            row = [
                (part << 32) | no, keys, held, lengths.tolist(), _squeeze(every), int(train.sum()), words, counts.tolist(),
                [ending(w, endings) for w in words],
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in common.pieces(batches, "text"):
            for key, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), common.utf8(batch, "text"), strict=True):
                words = text.lower().split()
                ids.append(np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words)) if words else np.empty(0, dtype=np.int64))
                ids[-1] = np.append(ids[-1], 0)
                keys.append(key)
                held.append(out)
                count += len(ids[-1])
                if count >= block_tokens:
                    yield flush()
                    seen.clear()
                    seen[b""] = 0
                    keys, held, ids, count, no = [], [], [], 0, no + 1
        if keys:
            yield flush()

    return docs.mapInArrow(run, BLOCKS)


def counted(held: DataFrame, least: float) -> DataFrame:
    """The blocks with, for each word of their list, its count in the whole corpus.

    ``words`` becomes an array of (pos, total, first, word), the word itself only where its total
    is at least ``least``, ``first`` in the first block that has the word; ``new_words`` counts
    the training words that have their first block here. Only (block, pos, word, count) rows are
    shuffled by word; endings and token indices stay with the block.
    """
    rows = held.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
    rows = rows.select("block", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    of_word = Window.partitionBy("word").orderBy("block")
    rows = rows.select(
        "block", "pos", "word",
        F.sum("n").over(of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        (F.row_number().over(of_word) == 1).alias("first"),
    )
    lists = rows.groupBy("block").agg(
        F.collect_list(F.struct("pos", "total", "first", F.when(F.col("total") >= least, F.col("word")).alias("word"))).alias("words"),
        F.sum((F.col("first") & (F.col("total") > 0)).cast("bigint")).alias("new_words"),
    )
    return held.select("block", "doc_ids", "held_out", "lengths", "ids", "endings").join(lists, "block")


def _word_list(cell: pa.StructArray, endings: pa.Array, frequent: pa.Array, n_frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """(total, item) by word index of a block; items: end, words with a class of their own, endings."""
    pos = cell.field("pos").to_numpy(zero_copy_only=False)
    total = np.empty(len(pos), dtype=np.int64)
    total[pos] = cell.field("total").to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(cell.field("word"), value_set=frequent), -1).to_numpy(zero_copy_only=False)
    own = np.empty(len(pos), dtype=np.int64)
    own[pos] = at
    item = np.where(own >= 0, own + 1, endings.to_numpy(zero_copy_only=False) + 1 + n_frequent)
    item[0] = 0
    return total, item


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Item -> class by exchange: each item in turn moves to the class that raises the likelihood
    of the class bigrams most. Item 0 (the end of a text) is class 0 alone; no item joins it."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    label = np.zeros(n, dtype=np.int64)
    # a start without the symmetries of dealing out in turn, at which no single move gains
    label[order[order != 0]] = np.random.default_rng(0).integers(1, classes, n - 1)
    member = np.eye(classes)[label]
    joint = member.T @ bigrams @ member

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)

    live = [i for i in order if i and weight[i] > 0]
    for _ in range(sweeps):
        moved = 0
        for i in live:
            a = label[i]
            right = np.bincount(label, weights=bigrams[i], minlength=classes)
            left = np.bincount(label, weights=bigrams[:, i], minlength=classes)
            own = bigrams[i, i]
            right[a] -= own
            left[a] -= own
            # take i out of its class
            joint[a] -= right
            joint[:, a] -= left
            joint[a, a] -= own
            rows, cols = joint.sum(axis=1), joint.sum(axis=0)
            # gain of putting i into each class: changed cells of its row and column, less the margins
            row = xlogx(joint + right) - xlogx(joint)
            col = xlogx(joint + left[:, None]) - xlogx(joint)
            d = np.diag(joint)
            gain = row.sum(axis=1) - np.diag(row) + col.sum(axis=0) - np.diag(col)
            gain += xlogx(d + right + left + own) - xlogx(d)
            gain -= xlogx(rows + right.sum() + own) - xlogx(rows) + xlogx(cols + left.sum() + own) - xlogx(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += right
            joint[:, b] += left
            joint[b, b] += own
            moved += b != a
            label[i] = b
        if not moved:
            break
    return label


@dataclass
class Model:
    frequent: list[bytes]
    label: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    size: np.ndarray  # training tokens by class
    distinct: np.ndarray  # distinct training words by class
    tokens: int
    vocabulary: int
    discount: float = 0.5

    def emission(self, total: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 P(word | class); the discounted mass of a class goes to its one unseen word."""
        size, unseen = self.size[kind].astype(float), self.discount * self.distinct[kind]
        p = np.where(total > 0, total - self.discount, unseen) / np.maximum(size, 1.0)
        return np.log10(np.where(size > 0, p, 1.0))


def _sum_matrices(df: DataFrame, column: str) -> DataFrame:
    """Add up equally sized int64 arrays (as bytes) by ``column``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = None, None
        for batch in batches:
            for key, data in zip(batch.column(column).to_pylist(), batch.column("data"), strict=True):
                values = np.frombuffer(data.as_py(), dtype="<i8")
                keys, sums = key, values.copy() if sums is None else sums + values
        yield pa.RecordBatch.from_arrays([pa.array([keys], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=[column, "data"])

    return df.groupBy(column).applyInArrow(add, f"{column} INT, data BINARY")


def train(counted_blocks: DataFrame, frequent: list[bytes], tokens: int, vocabulary: int, classes: int, endings: int, slices: int = 32) -> Model:
    """Learn the model from all training tokens of the blocks; ``words`` are the exchange items.

    Each task adds the item bigrams of its blocks into one matrix and sends it in ``slices`` row
    slices, which are added up in two rounds (64 groups of tasks, then all), so that no task reads
    what every other has sent; the sum (items squared, bounded) comes to the driver for the exchange.
    """
    n_items = 1 + len(frequent) + endings

    def count(batches):
        value_set = pa.array(frequent, pa.binary())
        rows = np.zeros((n_items + 1, n_items), dtype=np.int64)  # the last: distinct training words
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                total, item = _word_list(words, batch.column("endings")[i].values, value_set, len(frequent))
                first = np.empty(len(total), dtype=bool)
                first[words.field("pos").to_numpy(zero_copy_only=False)] = words.field("first").to_numpy(zero_copy_only=False)
                rows[-1] += np.bincount(item[first & (total > 0)], minlength=n_items)
                lengths = np.array(batch.column("lengths")[i].as_py())
                train = np.repeat(~np.array(batch.column("held_out")[i].as_py()), lengths)
                seq = item[_expand(batch.column("ids")[i].as_py())]
                before = np.r_[0, seq[:-1]]  # what precedes a text is the end of another
                pairs = np.bincount((before * n_items + seq)[train], minlength=n_items * n_items)
                rows[:-1] += pairs.reshape(n_items, n_items)
        group = TaskContext.get().partitionId() % 64
        for k, part in enumerate(np.array_split(rows, slices)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([64 * k + group], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["slice", "data"])

    sums = np.zeros((n_items + 1, n_items), dtype=np.int64)
    cut = np.array_split(np.arange(n_items + 1), slices)
    sent = counted_blocks.select("words", "endings", "lengths", "held_out", "ids").mapInArrow(count, "slice INT, data BINARY")
    grouped = _sum_matrices(sent, "slice").select((F.col("slice") / 64).cast("int").alias("slice"), "data")
    for r in _sum_matrices(grouped, "slice").collect():  # `slices` rows
        sums[cut[r["slice"]]] = np.frombuffer(r["data"], dtype="<i8").reshape(-1, n_items)
    bigrams = sums[:-1].astype(float)
    label = exchange(bigrams, classes)
    member = np.eye(classes)[label]
    joint = member.T @ bigrams @ member
    size = joint.sum(axis=0)
    distinct = np.bincount(label, weights=sums[-1], minlength=classes).astype(np.int64)
    return Model(frequent, label, transitions(joint), size, distinct, tokens, vocabulary)


def settle(counted_blocks: DataFrame, model: Model, words: list[bytes], endings: int, slices: int = 32) -> Model:
    """The model with every one of ``words`` in the class its own class contexts make most likely.

    One pass counts, for each word, the classes before and after it, the class bigrams being those of
    ``model``; a word goes to the class c of the greatest sum of log P(c | before), log P(after | c)
    and the cost of sharing c's mass. A second pass counts the bigrams and words of the new classes. What goes to
    the driver is ``len(words)`` x 2 classes numbers, and classes squared.
    """
    classes, known = len(model.size), len(model.frequent)
    # items of the new model: the end, exchange items, further words, endings
    every = model.frequent + words
    label = np.r_[model.label[: 1 + known], np.full(len(words), -1), model.label[1 + known :]]
    shared = counted_blocks.sparkSession.sparkContext.broadcast((every, model.label, label))
    n, cut = len(words), np.array_split(np.arange(len(words)), slices)

    def sequences(batches, value_set, labels, count):
        """(item, class, training mask, class before) of the tokens of each block."""
        for batch in batches:
            for i in range(batch.num_rows):
                cell, tails = batch.column("words")[i].values, batch.column("endings")[i].values
                _, item = _word_list(cell, tails, value_set, count)
                lengths = np.array(batch.column("lengths")[i].as_py())
                mask = np.repeat(~np.array(batch.column("held_out")[i].as_py()), lengths)
                yield cell, tails, item, _expand(batch.column("ids")[i].as_py()), mask

    def contexts(batches):
        every, old, _ = shared.value
        mine, theirs = pa.array(every, pa.binary()), pa.array(every[:known], pa.binary())
        sums = np.zeros((n, 2 * classes), dtype=np.int64)
        for cell, tails, item, ids, mask in sequences(batches, mine, None, len(every)):
            _, coarse = _word_list(cell, tails, theirs, known)
            kind = old[coarse][ids]
            at = item[ids] - 1 - known
            ours = (at >= 0) & (at < n) & mask
            before = np.r_[0, kind[:-1]]
            after = np.r_[kind[1:], 0]
            flat = np.bincount(at[ours] * 2 * classes + before[ours], minlength=n * 2 * classes)
            flat += np.bincount(at[ours] * 2 * classes + classes + after[ours], minlength=n * 2 * classes)
            sums += flat.reshape(n, 2 * classes)
        group = TaskContext.get().partitionId() % 64
        for k, rows in enumerate(cut):
            if len(rows) and sums[rows].any():
                yield pa.RecordBatch.from_arrays([pa.array([64 * k + group], pa.int32()), pa.array([sums[rows].astype("<i8").tobytes()], pa.binary())], names=["slice", "data"])

    columns = ["words", "endings", "lengths", "held_out", "ids"]

    def added(sent):
        grouped = _sum_matrices(sent, "slice").select((F.col("slice") / 64).cast("int").alias("slice"), "data")
        return _sum_matrices(grouped, "slice").collect()

    found = np.zeros((n, 2 * classes), dtype=np.int64)
    for r in added(counted_blocks.select(*columns).mapInArrow(contexts, "slice INT, data BINARY")):
        found[cut[r["slice"]]] = np.frombuffer(r["data"], dtype="<i8").reshape(-1, 2 * classes)
    forward = model.transition * np.log(10)  # [before, class]
    gain = found[:, :classes] @ forward + found[:, classes:] @ forward.T
    # a word's share of its class: the same count weighs less in a larger class
    gain -= found[:, :classes].sum(1)[:, None] * np.log(np.maximum(model.size, 1.0))[None, :]
    gain[:, 0] = -np.inf  # the end of a text is alone
    gain[:, model.size == 0] = -np.inf
    label[1 + known : 1 + known + n] = gain.argmax(1)
    shared_label = counted_blocks.sparkSession.sparkContext.broadcast((every, label))

    def bigrams(batches):
        every, label = shared_label.value
        mine = pa.array(every, pa.binary())
        sums = np.zeros((classes + 1, classes), dtype=np.int64)
        for cell, tails, item, ids, mask in sequences(batches, mine, label, len(every)):
            total, _ = _word_list(cell, tails, mine, len(every))
            first = np.empty(len(item), dtype=bool)
            first[cell.field("pos").to_numpy(zero_copy_only=False)] = cell.field("first").to_numpy(zero_copy_only=False)
            sums[-1] += np.bincount(label[item[first & (total > 0)]], minlength=classes)
            kind = label[item][ids]
            pairs = (np.r_[0, kind[:-1]] * classes + kind)[mask]
            sums[:-1] += np.bincount(pairs, minlength=classes * classes).reshape(classes, classes)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([sums.astype("<i8").tobytes()], pa.binary())], names=["slice", "data"])

    total = np.zeros((classes + 1, classes), dtype=np.int64)
    for r in added(counted_blocks.select(*columns).mapInArrow(bigrams, "slice INT, data BINARY")):
        total += np.frombuffer(r["data"], dtype="<i8").reshape(classes + 1, classes)
    joint = total[:-1].astype(float)
    return Model(every, label, transitions(joint), joint.sum(axis=0), total[-1], model.tokens, model.vocabulary)


def transitions(joint: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from class bigram counts, shrunk towards the class frequencies."""
    size = joint.sum(axis=0)
    share = (size + 0.5) / (size.sum() + 0.5 * len(size))
    return np.log10((joint + 50.0 * share) / (joint.sum(axis=1, keepdims=True) + 50.0))


SCORES = "doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE"


def score(counted_blocks: DataFrame, model: Model) -> DataFrame:
    """One row per document with its unigram baseline and model log10 probabilities."""
    shared = counted_blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        value_set = pa.array(m.frequent, pa.binary())
        schema = common.arrow_schema(SCORES)
        for batch in batches:
            for i in range(batch.num_rows):
                total, item = _word_list(batch.column("words")[i].values, batch.column("endings")[i].values, value_set, len(m.frequent))
                ids = _expand(batch.column("ids")[i].as_py())
                lengths = np.array(batch.column("lengths")[i].as_py())
                starts = np.cumsum(lengths) - lengths
                kind = m.label[item]
                seq = kind[ids]
                base = np.log10((total + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))[ids]
                own = m.transition[np.r_[0, seq[:-1]], seq] + m.emission(total, kind)[ids]
                cols = [
                    batch.column("doc_ids")[i].values, batch.column("held_out")[i].values, pa.array(lengths),
                    pa.array(np.add.reduceat((total > 0)[ids].astype(np.int64), starts)),
                    pa.array(np.full(len(lengths), m.tokens)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return counted_blocks.select("words", "endings", "ids", "lengths", "doc_ids", "held_out").mapInArrow(run, SCORES)


def class_scores(docs: DataFrame, held_out, classes: int = 48, endings: int = 1024, frequent: float = 1 / 2000, own: float = 1 / 50_000, rounds: int = 1) -> DataFrame:
    """Scores of every row of ``docs``; ``held_out`` (a column) marks rows not to learn from.

    Null text is empty (one token, the end). Repeated rows count and are scored each. An empty
    table gives no rows. Both thresholds are relative, so they are the same at every size.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held_out"))
    held = common.stored(blocks(d, endings), "brown-blocks")
    tokens = held.agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]
    full = common.stored(counted(held, max(1.0, tokens * min(own, frequent))), "brown-counted")
    vocabulary = full.agg(F.coalesce(F.sum("new_words"), F.lit(0))).first()[0]
    listed = full.select(F.explode(F.transform(F.filter("words", lambda w: w["first"] & w["word"].isNotNull()), lambda w: F.struct(w["word"].alias("word"), w["total"].alias("total")))).alias("w"))
    # at most 1 / own words; the empty one is the end of a text
    words = sorted((bytes(r["word"]), r["total"]) for r in listed.select("w.word", "w.total").collect() if bytes(r["word"]))
    top = [w for w, n in words if n >= max(1.0, tokens * frequent)]
    model = train(full, top, tokens, vocabulary, classes, endings)
    more = [w for w, n in words if n < max(1.0, tokens * frequent)]
    for _ in range(rounds if more else 0):
        model = settle(full, Model(top, np.r_[model.label[: 1 + len(top)], model.label[-endings:]], model.transition, model.size, model.distinct, tokens, vocabulary), more, endings)
    return score(full, model)


def op10_brown_classes(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose id checksum modulo 5 is not 1."""
    return class_scores(common.table(spark, sf_dir, "documents"), common.is_held_out("doc_id", 5, 1))
