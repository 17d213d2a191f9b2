"""Language model of word classes: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.llm.common import id_remainder, small_batches, table, written

CLASSES = 64
FREQUENT = 1 / 2000
"""A word of at least this share of all training tokens is a unit of the first clustering: at most 2000 words."""
OWN = 1
"""A word that occurs so often in training texts is exchanged itself: every one that occurs at all."""
SUFFIXES = 512
"""In the first clustering other words are units by a hash of their last bytes. Words that no training text has
stay in the class of theirs."""
BUCKETS = 256
"""Words are dealt by key: a bucket is what one task judges at once."""
BUCKET_BLOCKS = 4096
"""So many blocks have ``BUCKETS`` buckets, more blocks as many times more."""
MERGE = 4_000_000
"""So many sums of a bucket are added up before more are read."""
JUDGED = 8192
"""So many sums, or a quarter as many words, are judged at once."""
KEY_SEED = 42
"""With this seed the hash of a word's bytes is that of SQL's ``xxhash64``."""
SUFFIX_BYTES = 3
SWEEPS = 12
WORD_SWEEPS = 1
"""Of the query, over all words: more raise the likelihood of the training texts, but lower that of others."""
BACKOFF = 1.0
BLOCK_WORDS = 1_500_000

END = 0


def suffix(word: bytes) -> int:
    value = 0
    for byte in word[-SUFFIX_BYTES:]:
        value = (value * 257 + byte + 1) % 1_000_003
    return value % SUFFIXES


class Block:
    """Documents of one task as numbers into a word list of their own; number 0 ends a document."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.doc_ids: list[int | None] = []
        self.trains: list[bool] = []
        self.codes: list[np.ndarray] = []
        self.words = 0

    def add(self, doc_id: int | None, train: bool, raw: bytes) -> None:
        words = raw.lower().split()
        numbers = self.numbers
        codes = [numbers.setdefault(word, len(numbers) + 1) for word in words]
        codes.append(END)
        self.doc_ids.append(doc_id)
        self.trains.append(train)
        self.codes.append(np.array(codes, dtype=np.int32))
        self.words += len(codes)

    def batch(self, block: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        lengths = np.array([len(c) for c in self.codes], dtype=np.int32)
        learned = np.concatenate([np.empty(0, np.int32), *(c for c, t in zip(self.codes, self.trains, strict=True) if t)])
        counts = np.bincount(learned, minlength=len(self.numbers) + 1)
        words = list(self.numbers)
        kinds = ["doc_ids", "trains", "lengths", "codes", "words", "counts", "suffixes", "ends", "learned"]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([self.doc_ids], pa.list_(pa.int64())),
                pa.array([self.trains], pa.list_(pa.bool_())),
                pa.array([lengths.tobytes()], pa.binary()),
                pa.array([zstandard.compress(codes.tobytes(), 1)], pa.binary()),
                pa.array([words], pa.list_(pa.binary())),
                pa.array([counts[1:]], pa.list_(pa.int64())),
                pa.array([np.array([suffix(word) for word in words], dtype=np.uint16).tobytes()], pa.binary()),
                pa.array([int(counts[END])], pa.int64()),
                pa.array([len(learned)], pa.int64()),
            ],
            names=["block", *kinds],
        )


BLOCK_SCHEMA = (
    "block long, doc_ids array<long>, trains array<boolean>, lengths binary, codes binary, words array<binary>,"
    " counts array<long>, suffixes binary, ends long, learned long"
)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, number = Block(), TaskContext.get().partitionId() << 32
    for batch in batches:
        columns = (batch[name].to_pylist() for name in ("doc_id", "train", "raw"))
        for doc_id, train, raw in zip(*columns, strict=True):
            block.add(doc_id, train, raw or b"")
            if block.words >= BLOCK_WORDS:
                yield block.batch(number)
                block, number = Block(), number + 1
    if block.doc_ids:
        yield block.batch(number)


def decoded(codes: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(codes), dtype=kind)


def block_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's blocks one by one; their words stay in Arrow."""
    names = batch.schema.names
    for at in range(batch.num_rows):
        yield {name: batch[name][at].values if name == "words" else batch[name][at].as_py() for name in names}


def own_units(row: dict, frequent: pa.Array) -> np.ndarray:
    """The unit of each number of a block."""
    units = np.r_[END, 1 + len(frequent) + np.frombuffer(row["suffixes"], dtype=np.uint16).astype(np.int64)]
    place = pc.index_in(row["words"], value_set=frequent).fill_null(-1).to_numpy()
    found = np.flatnonzero(place >= 0)
    units[1 + found] = 1 + place[found]
    return units


def learned(row: dict) -> np.ndarray:
    """The numbers of a block's training texts, one after the other."""
    lengths = np.frombuffer(row["lengths"], dtype=np.int32)
    return decoded(row["codes"])[np.repeat(np.array(row["trains"], dtype=bool), lengths)]


def after_end(sequence: np.ndarray) -> np.ndarray:
    """What stands before each token: a text follows an end."""
    return np.r_[END, sequence[:-1]][: len(sequence)]


def summed_pairs(total: np.ndarray) -> pa.RecordBatch:
    pairs = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(total[pairs], pa.int64())], names=["pair", "n"])


def unit_pairs(frequent: pa.Array, units: int):
    """How often one unit follows another in training texts, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, dtype=np.int64)
        for batch in batches:
            for row in block_rows(batch):
                sequence = own_units(row, frequent)[learned(row)]
                pairs, counts = np.unique(after_end(sequence) * units + sequence, return_counts=True)
                total[pairs] += counts
        yield summed_pairs(total)

    return run


def _xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def gains(joint: np.ndarray, right: np.ndarray, left: np.ndarray, self_pairs: int, weight: int) -> np.ndarray:
    """What each class gains in likelihood by a word, of which ``joint`` holds nothing: how often it stands
    before (``right``) and behind (``left``) the words of each class, before itself and at all."""
    # Wherever the word goes, the pairs with it behind a class stay that class's.
    size = joint.sum(axis=1) + left
    now = _xlogx(joint)
    gain = (_xlogx(joint + right) - now).sum(axis=1) + (_xlogx(joint + left[:, None]) - now).sum(axis=0)
    own = np.diagonal(joint)
    gain += _xlogx(own + right + left + self_pairs) - _xlogx(own + right) - _xlogx(own + left) + _xlogx(own)
    return gain - 2 * (_xlogx(size + weight) - _xlogx(size))


def better(gain: np.ndarray, old: int) -> int:
    """The class that gains most, the old one where none gains more. The class of ends takes no word."""
    best = int(gain[1:].argmax()) + 1
    return best if gain[best] > gain[old] + 1e-9 else old


def exchange(follows: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Assign units to classes so that the class bigram likelihood of the counts rises to a local optimum.

    ``follows[u, v]``: how often unit v follows unit u; unit 0 ends texts and keeps class 0 for itself.
    Units start in classes by frequency. In each sweep every unit, most frequent first, moves to the class
    that gains most, until none moves.
    """
    units = len(follows)
    weight = follows.sum(axis=0)
    order = [int(u) for u in np.argsort(-weight, kind="stable") if u != END]
    assigned = np.zeros(units, dtype=np.int64)
    for place, unit in enumerate(order):
        assigned[unit] = 1 + place % (classes - 1)
    member = np.zeros((units, classes), dtype=np.int64)
    member[np.arange(units), assigned] = 1
    to_class = follows @ member
    from_class = follows.T @ member
    joint = member.T @ to_class
    for _ in range(sweeps):
        moved = 0
        for unit in order:
            if not weight[unit]:
                continue
            old, self_pairs = int(assigned[unit]), int(follows[unit, unit])
            right, left = to_class[unit].copy(), from_class[unit].copy()
            right[old] -= self_pairs
            left[old] -= self_pairs
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= self_pairs
            gain = gains(joint, right, left, self_pairs, weight[unit])
            best = better(gain, old)
            joint[best] += right
            joint[:, best] += left
            joint[best, best] += self_pairs
            if best != old:
                moved += 1
                assigned[unit] = best
                to_class[:, old] -= follows[:, unit]
                to_class[:, best] += follows[:, unit]
                from_class[:, old] -= follows[unit]
                from_class[:, best] += follows[unit]
        if not moved:
            break
    return assigned


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(word, KEY_SEED) for word in words], dtype=np.uint64)


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The numbers between each two cuts as one binary value."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def summed(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the sum of their counts."""
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]][: len(flat)])
    return flat[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Neighbours:
    """For words by key: how often each class follows, precedes, and how often the word follows itself."""

    def __init__(self, classes: int) -> None:
        self.classes, self.width = classes, 2 * classes + 1
        self.rows: dict[int, int] = {}
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, sequence: np.ndarray, classes_of: np.ndarray, keys: np.ndarray, marked: np.ndarray) -> None:
        """Count a block's training texts; ``keys`` and ``marked`` lie by number less one."""
        places, rows = np.flatnonzero(marked), self.rows
        short = (len(rows) + len(places)) * self.width < 1 << 31
        at = np.full(len(keys) + 1, -1, dtype=np.int32 if short else np.int64)
        classes_of = classes_of.astype(at.dtype)
        at[places + 1] = [rows.setdefault(key, len(rows)) for key in keys[places].tolist()]
        before = after_end(sequence)
        row, row_before = at[sequence], at[before]
        here, there = row >= 0, row_before >= 0
        slots = [
            row_before[there] * self.width + classes_of[sequence[there]],
            row[here] * self.width + self.classes + classes_of[before[here]],
            row[here & (before == sequence)] * self.width + 2 * self.classes,
        ]
        self.found.append(np.unique(np.concatenate(slots), return_counts=True))

    def batch(self) -> pa.RecordBatch:
        flat, counts = summed(*map(np.concatenate, zip(*self.found, strict=True)))
        cuts = np.searchsorted(flat, np.arange(len(self.rows) + 1) * self.width)
        keys = np.array(list(self.rows), dtype=np.uint64).view(np.int64)
        slots = binaries((flat % self.width).astype(np.uint16), cuts)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), slots, binaries(counts.astype(np.uint32), cuts)], names=["key", "slots", "counts"]
        )


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


NEIGHBOURS = "bucket long, block long, rows binary"


def neighbours(classes_of_row: Callable[[dict], np.ndarray], classes: int, buckets: int):
    """Of each block all words with the classes of their neighbours in its training texts, as a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in block_rows(batch):
                found, classes_of = Neighbours(classes), classes_of_row(row)
                keys = word_keys(row["words"].to_pylist())
                found.add(learned(row), classes_of, keys, np.ones(len(keys), dtype=bool))
                sums = found.batch()
                # The number of each key; where words share one, that of the first.
                keep = np.unique([found.rows[key] for key in keys.tolist()], return_index=True)[1].astype(np.int64)
                sums = sums.append_column("number", pa.array((keep + 1).astype(np.int32)))
                sums = sums.append_column("old", pa.array(classes_of[keep + 1].astype(np.uint8)))
                bucket = (sums["key"].to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sums, cuts = sums.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1))
                filled = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(filled, pa.int64()),
                        pa.array([row["block"]] * len(filled), pa.int64()),
                        pa.array([packed(sums.slice(cuts[b], cuts[b + 1] - cuts[b])) for b in filled], pa.binary()),
                    ],
                    names=["bucket", "block", "rows"],
                )

    return run


class Bucket:
    """The words of a bucket: their neighbours added up over all blocks, and where they occur."""

    def __init__(self, classes: int) -> None:
        self.width = 2 * classes + 1
        self.keys, self.old = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint8)
        self.flat, self.counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.parts: list[pa.Table] = []
        self.waiting = 0
        self.places: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, block: int, rows: bytes) -> None:
        part = pa.ipc.open_stream(rows).read_all().combine_chunks()
        self.places.append((block, part["number"].to_numpy(), part["key"].to_numpy()))
        self.parts.append(part)
        self.waiting += part["slots"].nbytes // 2
        if self.waiting >= MERGE:
            self.merge()

    def merge(self) -> None:
        parts, self.parts, self.waiting = self.parts, [], 0
        if not parts:
            return
        given = [part["key"].to_numpy() for part in parts]
        keys, first, row = np.unique(np.concatenate([self.keys, *given]), return_index=True, return_inverse=True)
        old = np.concatenate([self.old, *(part["old"].to_numpy() for part in parts)])[first]
        held, more = row[: len(self.keys)], row[len(self.keys) :]
        values = [joined_numbers(part, name, kind) for name, kind in (("slots", np.uint16), ("counts", np.uint32)) for part in parts]
        slots, counts = values[: len(parts)], values[len(parts) :]
        sizes = np.concatenate([pc.binary_length(part["slots"]).to_numpy() // 2 for part in parts])
        flat = np.repeat(more, sizes) * self.width + np.concatenate(slots)
        moved = held[self.flat // self.width] * self.width + self.flat % self.width
        self.flat, self.counts = summed(np.r_[moved, flat], np.r_[self.counts, np.concatenate(counts).astype(np.int64)])
        self.keys, self.old = keys, old


def joined_numbers(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers that the binary values of a column hold, one after the other."""
    chunks = rows[name].chunks
    return np.concatenate([np.frombuffer(b"".join(chunk.to_pylist()), dtype=kind) for chunk in chunks] or [np.empty(0, kind)])


def all_gains(joint: np.ndarray, old: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``gains`` of many words, a row each, of which ``joint`` still holds what they have in their old classes.

    Only the pairs that a word occurs in change: so the sum goes over the classes that stand beside it.
    """
    words, classes = right.shape
    weight = left.sum(axis=1) + own
    each = np.arange(words)
    gain = np.zeros((words, classes))
    for table, here, other in ((joint.T, right, left), (joint, left, right)):
        word, beside = np.nonzero(here)
        if not len(word):
            continue
        known = _xlogx(table)
        n, from_old, old_class = here[word, beside], beside == old[word], old[word]
        # What the pairs of each class with the one beside hold without the word.
        rest, before = table[beside], known[beside]
        lines = np.flatnonzero(from_old)
        rest[lines] -= other[word[lines]]
        entries = np.arange(len(word))
        rest[entries, old_class] -= n + np.where(from_old, own[word], 0)
        before[lines] = _xlogx(rest[lines])
        before[entries, old_class] = _xlogx(rest[entries, old_class])
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        gain[word[first]] += np.add.reduceat(_xlogx(rest + n[:, None]) - before, first)
    pairs = np.tile(np.diagonal(joint), (words, 1))
    pairs[each, old] -= right[each, old] + left[each, old] + own
    gain += _xlogx(pairs + right + left + own[:, None]) - _xlogx(pairs + right) - _xlogx(pairs + left) + _xlogx(pairs)
    size = np.tile(joint.sum(axis=1), (words, 1))
    size[each, old] -= weight
    return gain - 2 * (_xlogx(size + weight[:, None]) - _xlogx(size))


def judged(bucket: Bucket, joint: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, old and best class of a bucket's words; those that occur more often than ``most`` stay."""
    bucket.merge()
    classes, width, joint = len(joint), bucket.width, joint.astype(np.float64)
    cuts = np.searchsorted(bucket.flat, np.arange(len(bucket.keys) + 1) * width)
    counts, old = np.zeros(len(bucket.keys), dtype=np.int64), bucket.old.astype(np.int64)
    best = old.copy()
    start = 0
    while start < len(old):
        # At least one word.
        end = min(start + JUDGED // 4, max(start + 1, int(np.searchsorted(cuts, cuts[start] + JUDGED, "right")) - 1))
        sums = np.zeros((end - start, width), dtype=np.int64)
        sums.reshape(-1)[bucket.flat[cuts[start] : cuts[end]] - start * width] = bucket.counts[cuts[start] : cuts[end]]
        right, left, own = sums[:, :classes], sums[:, classes:-1], sums[:, -1]
        counts[start:end] = left.sum(axis=1)
        may = np.flatnonzero((counts[start:end] >= OWN) & (counts[start:end] < most))
        if len(may):
            right, left, own, own_old = right[may], left[may], own[may], old[start + may]
            each = np.arange(len(may))
            right[each, own_old] -= own
            left[each, own_old] -= own
            gain = all_gains(joint, own_old, right, left, own)
            found = gain[:, 1:].argmax(axis=1) + 1
            more = gain[each, found] > gain[each, own_old] + 1e-9
            best[start + may[more]] = found[more]
        start = end
    return counts, old, best


MOVES = "block long, numbers binary, classes binary, known binary, totals binary"


def moves(joint: np.ndarray, most: float):
    """Every word goes to the class that gains most by it, each judged against the same counts.

    Rows come sorted by bucket. Each block gets the classes and counts of its words back, and a row without a
    block has the bucket's totals: distinct words of each class, words that occur once, twice, and moved ones.
    """
    classes = len(joint)

    def told(bucket: Bucket) -> Iterator[pa.RecordBatch]:
        counts, old, best = judged(bucket, joint, most)
        types = np.bincount(best[counts > 0], minlength=classes)
        totals = np.r_[types, (counts == 1).sum(), (counts == 2).sum(), (best != old).sum()].astype(np.int64)
        rows = [(None, None, None, None, totals.tobytes())]
        for block, numbers, keys in bucket.places:
            at = np.searchsorted(bucket.keys, keys)
            known = at[counts[at] > 0], numbers[counts[at] > 0]
            values = known[1].astype(np.int32), best[known[0]].astype(np.uint8), counts[known[0]]
            rows.append((block, *(zstandard.compress(value.tobytes(), 1) for value in values), None))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in MOVES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bucket = None, Bucket(classes)
        for batch in batches:
            for row in batch.to_pylist():
                if number is not None and row["bucket"] != number:
                    yield from told(bucket)
                    bucket = Bucket(classes)
                number = row["bucket"]
                bucket.add(row["block"], row["rows"])
        if number is not None:
            yield from told(bucket)

    return run


def block_classes(row: dict, suffix_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class and count of each number of a block: where no training text has the word, that of its suffix and 0."""
    classes = np.r_[END, suffix_class[np.frombuffer(row["suffixes"], dtype=np.uint16)]]
    counts = np.zeros(len(classes), dtype=np.int64)
    for given in row["given"] or []:
        numbers = decoded(given["numbers"])
        classes[numbers] = decoded(given["classes"], np.uint8)
        counts[numbers] = decoded(given["known"], np.int64)
    return classes, counts


def class_pairs(suffix_class: np.ndarray, classes: int):
    """How often one class follows another in training texts, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for row in block_rows(batch):
                chain = block_classes(row, suffix_class)[0][learned(row)]
                total += np.bincount(after_end(chain) * classes + chain, minlength=classes * classes)
        yield summed_pairs(total)

    return run


def pair_matrix(pairs: DataFrame, side: int) -> np.ndarray:
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(side * side, dtype=np.int64)
    total[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    return total.reshape(side, side)


@dataclass
class Model:
    """Everything a score needs besides the counts and classes of words: bounded by suffixes and classes."""

    tokens: int
    types: int
    ends: int
    discount: float
    suffix_class: np.ndarray
    transition: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | class): known words give up a discount, which the unknown word of the class gets."""
        tokens, types = self.class_tokens[classes], self.class_types[classes]
        known = (counts - self.discount) / np.maximum(tokens, 1)
        unknown = np.where(tokens > 0, self.discount * types / np.maximum(tokens, 1), 1.0)
        return np.log10(np.where(counts > 0, known, unknown))


def frequent_words(blocks: DataFrame, tokens: int) -> list[bytes]:
    """Words of at least ``FREQUENT`` of all training tokens, at most its inverse, in order.

    Such a word has that share of some block too. Only words that have are added up.
    """
    zipped = F.explode(F.arrays_zip("words", "counts")).alias("w")
    entries = blocks.select("learned", zipped).select("learned", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    often = written(entries.where(F.col("n") >= F.greatest(F.lit(1.0), F.col("learned") * FREQUENT)).select("word").distinct(), "often")
    counted = entries.join(often, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(1.0, tokens * FREQUENT)).select("word").collect()
    return sorted(bytes(row["word"]) for row in rows)


def first_classes(blocks: DataFrame, words: list[bytes], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the units, which are the end, the frequent words, and all others by suffix; and how often one
    class follows another."""
    units = 1 + len(words) + SUFFIXES
    texts = blocks.select("lengths", "trains", "codes", "words", "suffixes")
    follows = pair_matrix(texts.mapInArrow(unit_pairs(pa.array(words, pa.binary()), units), "pair long, n long"), units)
    unit_class = exchange(follows, classes)
    member = np.zeros((units, classes), dtype=np.int64)
    member[np.arange(units), unit_class] = 1
    return unit_class, member.T @ follows @ member


def likelihood(joint: np.ndarray) -> float:
    """What the classes make of the log likelihood of the training texts."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=0)).sum() - _xlogx(joint.sum(axis=1)).sum())


def cluster(blocks: DataFrame, tokens: int, classes: int, sweeps: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks with the classes and counts of their words, the classes of the suffixes, how often one class
    follows another, and the totals of ``moves``.

    First the units are exchanged: frequent words, and all others by suffix. Then every word of a training text
    leaves its class for the one that gains most by it, in all of them at once, by its neighbours' classes
    in all training texts. Sweeps go on while they raise the likelihood and a word moves, at most ``sweeps`` times.
    """
    words = frequent_words(blocks, tokens)
    frequent = pa.array(words, pa.binary())
    unit_class, joint = first_classes(blocks, words, classes)
    suffix_class = unit_class[-SUFFIXES:]
    buckets = BUCKETS * -(-max(1, blocks.count()) // BUCKET_BLOCKS)
    rows, totals = blocks, None
    for sweep in range(sweeps):
        classes_of = (lambda row: block_classes(row, suffix_class)[0]) if sweep else (lambda row: unit_class[own_units(row, frequent)])
        texts = rows.select("block", "lengths", "trains", "codes", "words", "suffixes", *(["given"] if sweep else []))
        sums = texts.mapInArrow(neighbours(classes_of, classes, buckets), NEIGHBOURS)
        best = sums.repartition("bucket").sortWithinPartitions("bucket")
        with small_batches(blocks.sparkSession, 100):
            told = written(best.mapInArrow(moves(joint, max(1.0, tokens * FREQUENT)), MOVES), "moves")
        given = F.collect_list(F.struct("numbers", "classes", "known")).alias("given")
        kept = ["block", "doc_ids", "trains", "lengths", "codes", "suffixes", *(["words"] if sweep + 1 < sweeps else [])]
        of_blocks = told.where("block is not null").groupBy("block").agg(given)
        swept = written(blocks.select(*kept).join(of_blocks, "block", "left"), "classed")
        joined = pair_matrix(swept.mapInArrow(class_pairs(suffix_class, classes), "pair long, n long"), classes)
        if sweep and likelihood(joined) <= likelihood(joint):
            break
        rows, joint, totals = swept, joined, np.zeros(classes + 3, dtype=np.int64)
        for row in told.where("block is null").select("totals").toLocalIterator():
            totals += np.frombuffer(row["totals"], dtype=np.int64)
        if not totals[-1]:
            break
    return rows, suffix_class, joint, totals


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in block_rows(batch):
                classes, counts = block_classes(row, model.suffix_class)
                counts[END] = model.ends
                emission = model.emission(counts, classes)
                base = np.log10((counts + 1) / (model.tokens + model.types + 1))
                codes, lengths = decoded(row["codes"]), np.frombuffer(row["lengths"], dtype=np.int32)
                chain = classes[codes]
                before = after_end(chain)
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
                sums = lambda values: np.add.reduceat(values, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([not t for t in row["trains"]], pa.bool_()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums((counts[codes] > 0).astype(np.int64)), pa.int64()),
                        pa.array(np.full(len(lengths), model.tokens), pa.int64()),
                        pa.array(sums(base[codes]), pa.float64()),
                        pa.array(sums(emission[codes] + model.transition[before, chain]), pa.float64()),
                    ],
                    names=[field.split()[0] for field in SCORES.split(", ")],
                )

    return run


def scored(
    docs: DataFrame, modulus: int = 7, held_remainder: int = 2, classes: int = CLASSES, sweeps: int = 1
) -> DataFrame:
    """Score documents (doc_id, text) by a class model learned from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, the
    model's log10 probability of the text: for each token its class given the class before, and the word
    given its class. 10 ** (-score / n_tokens) is the perplexity.

    Documents become blocks of word numbers once; only the distinct words of a block go to the others, with
    what stands beside them. Units, which are frequent words and suffixes, are exchanged on the matrix of their
    pairs, at most 2513 square. Then each word of a training text is exchanged by itself, in parallel, by the
    classes of its neighbours in all training texts, in at most ``sweeps`` sweeps, as long as they raise the
    likelihood; only words without any occurrence there keep the class of their suffix.

    Null and empty texts are a lone end. Held out are rows whose crc32 of the id as text leaves
    ``held_remainder``; a null id is not held out. Repeated rows count as often as they occur. With nothing
    to learn from, train_tokens is 0 and every token unknown. Other columns are not read. No documents give
    no rows.
    """
    spark = docs.sparkSession
    train = ~F.coalesce(id_remainder("doc_id", modulus) == held_remainder, F.lit(False))
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.col("text").cast("binary").alias("raw")
    )
    with small_batches(spark):
        blocks = written(given.mapInArrow(encode, BLOCK_SCHEMA), "blocks")
    with small_batches(spark, 1):
        ends, tokens = (n or 0 for n in blocks.agg(F.sum("ends"), F.sum("learned")).first())
        rows, suffix_class, joint, totals = cluster(blocks, tokens, classes, sweeps)
        class_types, (once, twice) = totals[:classes], totals[classes:-1].tolist()
        types = int(class_types.sum())
        class_tokens = joint.sum(axis=0)
        class_types[END] = int(ends > 0)
        share = (class_tokens + 1) / (class_tokens.sum() + classes)
        model = Model(
            tokens=tokens,
            types=types + int(ends > 0),
            ends=ends,
            discount=once / (once + 2 * twice) if once and twice else 0.5,
            suffix_class=suffix_class,
            transition=np.log10((joint + BACKOFF * share) / (joint.sum(axis=1, keepdims=True) + BACKOFF)),
            class_tokens=class_tokens,
            class_types=class_types,
        )
        return written(rows.mapInArrow(scores(model), SCORES), "scores")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), sweeps=WORD_SWEEPS)
