"""Anchor points: records are sent to the anchors of their rarest tokens, and those that share enough of them are found.

Every token is an anchor. A record goes to those of its prefix, the tokens that come first in one order of all tokens; two
sets that are alike share ``needed`` of those (see ``shingles``). Any one order will do, so it is estimated from a sample
of fixed size: what is common there comes last, all else is ordered by hash. That costs no count of all tokens, and no
token but those of the prefixes leaves the task that reads its text.

What moves is packed into arrays, one for each batch and part of the anchors, with 32 bits of a token and of a key. Equal
bits of unlike tokens or keys only add candidates. The pairs that meet can be many times the records, so they are gathered
in passes; a pair belongs to one pass with all anchors it shares, and the files of a pass are gone before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.shingles import LOOSE, SPARE, shingled

#: Texts from which the order of tokens is estimated, and tokens of which it holds the place.
SAMPLE, PLACED = 20_000, 500_000
#: The shares of the pairs from which passes are made; bytes of pairs that any pass may gather, and as a share of the postings' bytes.
SHARES, PASS_BYTES, PASS_SHARE = 4096, 96_000_000, 0.25
#: Postings that are packed together; what a step looks up travels to each such pack, so a pack should hold many.
PACKED = 3_000_000
#: Postings of a part of the anchors, pairs looked at or held at once, and what the parts of a pair add up to.
PART, AT_ONCE, HELD, WHOLE = 500_000, 400_000, 1_200_000, 60_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are removed as soon as the query ends that wrote them; what is kept must be ``durable``."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@dataclass
class Order:
    """The tokens that are common in a sample, sorted, and how common they are on a scale of 1 to 255; others are at 0."""

    tokens: np.ndarray
    rank: np.ndarray

    def places(self, values: np.ndarray) -> np.ndarray:
        """A number for each token by which all tokens are ordered."""
        at = np.minimum(np.searchsorted(self.tokens, values), max(0, len(self.tokens) - 1))
        rank = np.where(self.tokens[at] == values, self.rank[at], 0).astype(np.uint64) if len(self.tokens) else np.zeros(len(values), np.uint64)
        return (rank << np.uint64(56)) | (values.view(np.uint64) >> np.uint64(8))


def order_of(rows: DataFrame, key: str, text: Column, length: int) -> Order:
    """The order of tokens, by a sample of the different texts."""
    shares = max(1, rows.count() // SAMPLE)
    some = shingled(rows.where(F.pmod(F.xxhash64(text), F.lit(shares)) == 0), key, text, length)
    tokens = some.groupBy("same").agg(F.first("tokens").alias("tokens")).select(F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("count")).where("count > 2").orderBy(F.desc("count"), "token").limit(PLACED).toArrow()
    values, counts = common.column("token").to_numpy(), common.column("count").to_numpy()
    o = np.argsort(values)
    return Order(values[o], np.minimum(255, 1 + 12 * np.log2(np.maximum(counts[o], 1))).astype(np.uint8))


def needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """As ``shingles.needed``."""
    return np.minimum(1 + n // SPARE, np.ceil(n * threshold - LOOSE)).astype(np.int64)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """As ``shingles.prefix_length``."""
    return (n - np.ceil(n * threshold - LOOSE)).astype(np.int64) + needed(n, threshold)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each list) of a column of lists of whole numbers."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of so many runs of these lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def with_prefixes(sets: DataFrame, order: Order | Broadcast, threshold: float) -> DataFrame:
    """``sets`` with (n, prefix) instead of tokens: their number, and four bytes of each token of the prefix, in order."""
    kept = [c for c in sets.columns if c != "tokens"]
    shared = sets.sparkSession.sparkContext.broadcast(order) if isinstance(order, Order) else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _lists(batch.column("tokens"))
            o = np.argsort(shared.value.places(values))
            owner = np.repeat(np.arange(len(n), dtype=np.uint16 if len(n) < 1 << 16 else np.int64), n)
            o = o[np.argsort(owner[o], kind="stable")]
            taken = prefix_length(n, threshold)
            low = values.view(np.uint64)[o[_within(n) < np.repeat(taken, n)]].astype(np.uint32)
            ends = np.append(0, np.cumsum(4 * taken)).astype(np.int32)
            prefix = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(low)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n.astype(np.int32)), prefix], names=[*kept, "n", "prefix"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema if f.name != "tokens")
    return sets.mapInArrow(run, f"{schema}, n int, prefix binary")


def key_bits(key: Column) -> Column:
    """32 bits of a key."""
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _blobs(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """(part, blob), one row for each part that occurs; a blob holds its rows of each column, one column after the other."""
    o = np.argsort(part.astype(np.uint16), kind="stable") if part.max(initial=0) < 1 << 16 else np.argsort(part, kind="stable")
    parts, starts = np.unique(part[o], return_index=True)
    ends = np.append(starts[1:], len(o))
    sorted_columns = [c[o] for c in columns]
    blobs = [b"".join(c[s:e].tobytes() for c in sorted_columns) for s, e in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _columns(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    rows = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, rows, at))
        at += rows * np.dtype(k).itemsize
    return out


def _posted(parts: int):
    """Postings (token, key bits, n, place), packed by part of the anchors; sets of up to 65,535 tokens take less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[type, list[tuple[np.ndarray, ...]]] = {np.uint16: [], np.uint32: []}

        def packed(width: type) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held[width], strict=True)]
            held[width].clear()
            made = _blobs((columns[0] % np.uint32(parts)).astype(np.int64), columns)
            return pa.RecordBatch.from_arrays([*made.columns, pa.array([width is np.uint32] * made.num_rows)], names=["part", "blob", "wide"])

        for batch in batches:
            h, n = batch.column("h").to_numpy().astype(np.uint32), batch.column("n").to_numpy()
            prefixes = batch.column("prefix").to_pylist()
            for width, some in ((np.uint16, np.flatnonzero(n < 1 << 16)), (np.uint32, np.flatnonzero(n >= 1 << 16))):
                if len(some):
                    token = np.frombuffer(b"".join(prefixes[i] for i in some), np.uint32)
                    lengths = np.array([len(prefixes[i]) // 4 for i in some])
                    held[width].append((token, np.repeat(h[some], lengths), np.repeat(n[some].astype(width), lengths), _within(lengths).astype(width)))
                    if sum(len(c[0]) for c in held[width]) >= PACKED:
                        yield packed(width)
        for width, some in held.items():
            if some:
                yield packed(width)

    return run


def _summed(ids: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different ids with the sum of their weights, which counts up to WHOLE."""
    all_ids = np.concatenate([np.zeros(0, np.uint64), *ids])
    o = np.argsort(all_ids)
    all_ids, all_weights = all_ids[o], np.concatenate([np.zeros(0, np.uint16), *weights])[o].astype(np.int64)
    starts = np.flatnonzero(np.append(True, all_ids[1:] != all_ids[:-1])) if len(all_ids) else np.zeros(0, np.int64)
    return all_ids[starts], np.minimum(np.add.reduceat(all_weights, starts), WHOLE).astype(np.uint16) if len(starts) else np.zeros(0, np.uint16)


def met(token: np.ndarray, h: np.ndarray, n: np.ndarray, place: np.ndarray, threshold: float, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, part) of the sets that meet at these anchors, where the shorter set's key lies in the shares from ``low`` to
    ``high``; for sets that are alike the parts of all anchors add up to WHOLE."""
    o = np.lexsort((h, n, token))
    token, h, n, place = token[o], h[o], n[o].astype(np.int64), place[o].astype(np.int64)
    need, behind = needed(n, threshold), n - place
    ends = np.repeat(*(lambda s: (np.append(s[1:], len(token)), np.diff(np.append(s, len(token)))))(np.flatnonzero(np.append(True, token[1:] != token[:-1]))))
    share = h % np.uint32(SHARES)
    # The other set is as long or longer, so this is the least that must lie behind the shorter one's place.
    first = np.flatnonzero((share >= low) & (share < high) & (behind >= 2 * n * (threshold / (1 + threshold)) - LOOSE - (need - 1)) & (ends > np.arange(len(token)) + 1))
    later = ends[first] - first - 1
    total = np.cumsum(later)
    ids, weights, held, at = [], [], 0, 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        i = np.repeat(first[at:upto], later[at:upto])
        j = i + 1 + _within(later[at:upto])
        at = upto
        ok = n[i] >= n[j] * threshold - LOOSE
        i, j = i[ok], j[ok]
        least = (n[i] + n[j]) * (threshold / (1 + threshold)) - LOOSE - (need[i] - 1)
        ok = (behind[i] >= least) & (behind[j] >= least)
        i, j = i[ok], j[ok]
        ids.append((h[i].astype(np.uint64) << np.uint64(32)) | h[j])
        weights.append((-(-WHOLE // need[i])).astype(np.uint16))
        held += len(i)
        if held >= HELD:
            yield _summed(ids, weights)
            ids, weights, held = [], [], 0
    if held:
        yield _summed(ids, weights)


def looked_up(new: list[np.ndarray], old: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, part), the new set first, of new sets that meet old ones; both are given as to ``met``, and parts add up so, too."""
    o = np.argsort(old[0], kind="stable")
    token, hb, nb, pb = (c[o] for c in old)
    nb, bb, needb = nb.astype(np.int64), nb.astype(np.int64) - pb, needed(nb.astype(np.int64), threshold)
    na, ba, needa = new[2].astype(np.int64), new[2].astype(np.int64) - new[3], needed(new[2].astype(np.int64), threshold)
    first = np.searchsorted(token, new[0], "left")
    n = np.searchsorted(token, new[0], "right") - first
    total = np.cumsum(n)
    ids, weights, held, at = [], [], 0, 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        i = np.repeat(np.arange(at, upto), n[at:upto])
        j = first[i] + _within(n[at:upto])
        at = upto
        need = np.minimum(needa[i], needb[j])
        least = (na[i] + nb[j]) * (threshold / (1 + threshold)) - LOOSE - (need - 1)
        ok = (nb[j] >= na[i] * threshold - LOOSE) & (na[i] >= nb[j] * threshold - LOOSE) & (ba[i] >= least) & (bb[j] >= least)
        i, j, need = i[ok], j[ok], need[ok]
        ids.append((new[1][i].astype(np.uint64) << np.uint64(32)) | hb[j])
        weights.append((-(-WHOLE // need)).astype(np.uint16))
        held += len(i)
        if held >= HELD:
            yield _summed(ids, weights)
            ids, weights, held = [], [], 0
    if held:
        yield _summed(ids, weights)


def _postings(blob: bytes, wide: bool) -> list[np.ndarray]:
    width = np.uint32 if wide else np.uint16
    return _columns(blob, [np.uint32, np.uint32, width, width])


def _looking(parts: int, threshold: float):
    """Pairs of rows (blobs, wides, blob, wide) of new and old postings of one part of the anchors, packed by part of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = [_postings(b, w) for b, w in zip(row["blobs"], row["wides"], strict=True)]
                for ids, weights in looked_up([np.concatenate(c) for c in zip(*held, strict=True)], _postings(row["blob"], row["wide"]), threshold):
                    if len(ids):
                        yield _blobs(((ids >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), [ids, weights])

    return run


def posted(prefixed: DataFrame, parts: int) -> DataFrame:
    """(part, blob, wide): the postings of (key, n, prefix), packed by part of the anchors."""
    return prefixed.select(key_bits(F.col("key")).alias("h"), "n", "prefix").mapInArrow(_posted(parts), "part int, blob binary, wide boolean")


def pairs_looked_up(rows: DataFrame, threshold: float) -> DataFrame:
    """(ha, hb), new and old, of rows (part, blobs, wides, blob, wide) that hold the new and some of the old postings of a part."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.select("blobs", "wides", "blob", "wide").mapInArrow(_looking(3 * parts, threshold), "part int, blob binary")
    return pairs.repartition(parts, "part").mapInArrow(_enough, "ha bigint, hb bigint, bytes bigint").where("ha is not null").select("ha", "hb")


def _meeting(parts: int, threshold: float, low: int, high: int):
    """Pairs of the parts of the anchors in this task, packed by part of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for blob, wide in zip(batch.column("blob").to_pylist(), batch.column("wide").to_pylist(), strict=True):
                for held, c in zip(some, _postings(blob, wide), strict=True):
                    held.append(c)
        if some[0]:
            for ids, weights in met(*[np.concatenate(c) for c in some], threshold, low, high):
                if len(ids):
                    yield _blobs(((ids >> np.uint64(32)) // np.uint64(SHARES) % np.uint64(parts)).astype(np.int64), [ids, weights])

    return run


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ha, hb, bytes): the pairs whose parts add up to the whole; one row without a pair has the bytes that came."""
    ids, weights, size = [], [], 0
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            one = _columns(blob, [np.uint64, np.uint16])
            ids.append(one[0])
            weights.append(one[1])
            size += len(blob)
    # The sum is taken of the weights as they are; each is cut at the whole already.
    pairs, sums = _summed(ids, weights)
    pairs = pairs[sums >= WHOLE]
    for high in range(0, len(pairs), 100_000):
        some = pairs[high : high + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array((some >> np.uint64(32)).astype(np.int64)), pa.array((some & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(np.zeros(len(some), np.int64))], names=["ha", "hb", "bytes"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([size], pa.int64())], names=["ha", "hb", "bytes"])


def meeting_pairs(prefixed: DataFrame, threshold: float, where: str) -> DataFrame:
    """(ha, hb), key bits of every pair of sets that share as many tokens of their prefixes as those that are alike.

    ``prefixed`` has (key, n, prefix) and must be durable; passes are written to ``where``, a folder that all executors share.
    """
    spark = prefixed.sparkSession
    postings = prefixed.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // (4 * PART)))
    low, high, n, schema = 0, SHARES // 32, 0, "ha bigint, hb bigint, bytes bigint"
    while low < SHARES:
        posts = posted(prefixed, 3 * parts).repartition(parts, "part")
        pairs = posts.mapInArrow(_meeting(3 * parts, threshold, low, high), "part int, blob binary").repartition(parts, "part")
        pairs.mapInArrow(_enough, schema).write.mode("overwrite").parquet(f"{where}/{n}")
        n += 1
        # The pairs of this pass tell how many shares the next can take.
        size = spark.read.schema(schema).parquet(f"{where}/{n - 1}").agg(F.sum("bytes")).first()[0] or 0
        most = max(PASS_BYTES, PASS_SHARE * postings)
        low, high = high, min(SHARES, high + max(1, int((high - low) * most / max(1, size))))
    return spark.read.schema(schema).parquet(*[f"{where}/{i}" for i in range(n)]).where("ha is not null").select("ha", "hb")


def marked(wanted: DataFrame) -> Broadcast:
    """A table in which the keys whose bits are in ``wanted``, one column with repeats, are marked: of sixteen bits for each
    and 8 MB at most, so some others seem marked, too. Who takes it must destroy it."""
    size = 1 << 26

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() % size
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.uint32).tobytes()]), pa.array([table[used].tobytes()])], names=["at", "marks"])

    table = np.zeros(size // 8, np.uint8)
    for at, some in wanted.coalesce(4).mapInArrow(run, "at binary, marks binary").toLocalIterator():
        table[np.frombuffer(at, np.uint32)] |= np.frombuffer(some, np.uint8)
    least = 16 * int(np.bitwise_count(table).sum())
    while len(table) > 1024 and 4 * len(table) >= least:
        table = table[: len(table) // 2] | table[len(table) // 2 :]
    return wanted.sparkSession.sparkContext.broadcast(table)


def chosen(rows: DataFrame, key: str, marks: Broadcast) -> DataFrame:
    """The rows whose key is marked."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in batches:
            at = batch.column("__bits").to_numpy() % (8 * len(table))
            yield batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    with_bits = rows.withColumn("__bits", key_bits(F.col(key)))
    return with_bits.mapInArrow(kept, with_bits.schema).drop("__bits")
