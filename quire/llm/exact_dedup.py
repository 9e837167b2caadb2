"""Exact dedup against a minimal perfect hash over historical distinct digests.

Texts are equal when they are identical after each run of white space becomes one space (digest: SHA-256 of that text in
UTF-8). The history is a table with one row for each bucket of digests: the bit levels of its minimal perfect hash, and in
slot order all 32 bytes of each digest and the locator of its winner (smallest doc_id) with the group size. A lookup
hashes to a slot and compares the bytes, so a digest that is not in the history is never taken for one. Members are
counted into their slots; digests that are no members are grouped by themselves, and their buckets are hashed anew.

Nulls: a null text counts as empty; a null doc_id counts as larger than any other, so it never wins where one is known.
Repeated rows are copies of each other: each gets its row back, and each row with the winning doc_id is marked kept. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, id_text, written

#: Bits for each key on a level of the hash; a key that meets another goes on to the next level.
GAMMA = 2
HISTORY = "bucket int, sizes array<int>, levels binary, digests binary, keep_ids array<long>, counts array<long>"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the digest of the normalised text."""
    rows = id_text(docs, id_col, text_col)
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return rows.select("doc_id", F.unhex(F.sha2(normal, 256)).alias("digest"))


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, digest, keep_id, n of each distinct digest, counted in each task before the shuffle."""
    out = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return out.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "digest", "keep_id", "n")


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the two first words of each digest, another one for each level."""
    with np.errstate(over="ignore"):
        x = words[:, 0] ^ (words[:, 1] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of its bit on the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(b) - b + base for b, base in zip(levels, np.cumsum([0, *(b.sum() for b in levels)]))]

    @classmethod
    def build(cls, digest: np.ndarray) -> PerfectHash:
        words = digest.view("<u8").reshape(len(digest), 4)
        levels: list[np.ndarray] = []
        left = np.arange(len(words))
        while len(left):
            size = max(64, GAMMA * len(left))
            at = (_mixed(words[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("two equal digests in one bucket of the history")
        return cls(levels)

    @classmethod
    def load(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8))
        ends = np.cumsum([-(-n // 8) * 8 for n in sizes])
        return cls([bits[e - -(-n // 8) * 8 :][:n].astype(bool) for n, e in zip(sizes, ends)])

    def packed(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.levels], b"".join(np.packbits(b).tobytes() for b in self.levels)

    def slots(self, digest: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that ends on no level."""
        words = digest.view("<u8").reshape(len(digest), 4)
        out, left = np.full(len(words), -1), np.arange(len(words))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mixed(words[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


def _bytes(column: pa.Array) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(-1, 32) if flat else np.zeros((0, 32), np.uint8)


def _stored(bucket: pa.Array, digest: np.ndarray, keep: pa.Array, n: pa.Array) -> pa.Table:
    """A bucket's row: its hash, and its slots in the order of the hash."""
    table = PerfectHash.build(digest)
    slot = table.slots(digest)
    order = np.empty(len(digest), np.int64)
    order[slot] = np.arange(len(digest))
    sizes, packed = table.packed()
    one = lambda x: pa.array([x.take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
    return pa.table({"bucket": bucket, "sizes": pa.array([sizes], pa.list_(pa.int32())), "levels": pa.array([packed], pa.binary()), "digests": pa.array([digest[order].tobytes()], pa.binary()), "keep_ids": one(keep), "counts": one(n)})


def _built(groups: pa.Table) -> pa.Table:
    groups = groups.combine_chunks()
    return _stored(groups.column("bucket").slice(0, 1), _bytes(groups.column("digest")), groups.column("keep_id"), groups.column("n"))


class Bucket:
    """A bucket of the history, read back: its hash and slots."""

    def __init__(self, row: dict):
        self.table = PerfectHash.load(row["sizes"], row["levels"])
        self.digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        self.keep, self.n = pa.array(row["keep_ids"], pa.int64()), pa.array(row["counts"], pa.int64())

    def find(self, digest: np.ndarray) -> np.ndarray:
        """The slot of each digest, compared byte by byte; -1 for those that are no members."""
        slot = self.table.slots(digest)
        member = slot >= 0
        member[member] = (self.digests[slot[member]] == digest[member]).all(1)
        return np.where(member, slot, -1)


def _looked_up(key, history: pa.Table, new: pa.Table) -> pa.Table:
    if not history.num_rows or not new.num_rows:
        return pa.table({"digest": pa.array([], pa.binary()), "old_keep": pa.array([], pa.int64()), "old_n": pa.array([], pa.int64())})
    bucket = Bucket(history.to_pylist()[0])
    slot = bucket.find(_bytes(new.column("digest")))
    rows = pa.array(slot[slot >= 0])
    return pa.table({"digest": new.column("digest").filter(pa.array(slot >= 0)), "old_keep": bucket.keep.take(rows), "old_n": bucket.n.take(rows)})


def _grown(key, history: pa.Table, new: pa.Table) -> pa.Table:
    """A bucket after the new groups: members counted into their slots, nonmembers added."""
    if not history.num_rows:
        return _built(new)
    if not new.num_rows:
        return history
    bucket = Bucket(history.to_pylist()[0])
    digest, new = _bytes(new.column("digest")), new.combine_chunks()
    slot = bucket.find(digest)
    hit = slot >= 0
    n = bucket.n.to_numpy().copy()
    n[slot[hit]] += new.column("n").to_numpy()[hit]
    beside = np.full(len(n), -1)
    beside[slot[hit]] = np.flatnonzero(hit)
    other = new.column("keep_id").combine_chunks().take(pa.array(beside, mask=beside < 0))
    keep = pc.min_element_wise(bucket.keep, other)
    if hit.all():
        sizes = history.select(["bucket", "sizes", "levels", "digests"])
        return sizes.append_column("keep_ids", pa.array([keep.to_pylist()], pa.list_(pa.int64()))).append_column("counts", pa.array([n.tolist()], pa.list_(pa.int64())))
    fresh = new.filter(pa.array(~hit)).combine_chunks()
    both = lambda old, more: pa.concat_arrays([old, more.combine_chunks()])
    return _stored(history.column("bucket"), np.concatenate([bucket.digests, digest[~hit]]), both(keep, fresh.column("keep_id")), both(pa.array(n), fresh.column("n")))


def stored(groups: DataFrame) -> DataFrame:
    """HISTORY rows of distinct digests (bucket, digest, keep_id, n)."""
    return groups.groupBy("bucket").applyInArrow(_built, HISTORY)


def lookup(history: DataFrame, new: DataFrame) -> DataFrame:
    """digest, old_keep, old_n of the new digests that the history holds."""
    return history.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(_looked_up, "digest binary, old_keep long, old_n long")


def merge_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """HISTORY after a new batch of distinct digests (bucket, digest, keep_id, n)."""
    return history.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(_grown, HISTORY)


def _slots(batches):
    for rows in batches:
        for row in rows.to_pylist():
            digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(row["counts"]), [None, pa.py_buffer(row["digests"])])
            whole = pa.record_batch([digest.cast(pa.binary()), pa.array(row["keep_ids"], pa.int64()), pa.array(row["counts"], pa.int64())], names=["digest", "keep_id", "group_size"])
            yield from (whole.slice(k, 1 << 16) for k in range(0, whole.num_rows, 1 << 16))


def winners(history: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of every slot."""
    return history.select("digests", "keep_ids", "counts").mapInArrow(_slots, "digest binary, keep_id long, group_size long")


def bucket_count(rows: int, per_bucket: int = 200_000) -> int:
    """Buckets of about so many digests: a bucket's hash and slots stay below 20 MB however large the history is."""
    return max(8, -(-rows // per_bucket))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 200_000) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    The documents come in two loads dealt by a hash of the id: the first is the history, the second is looked up in it;
    what is no member is grouped separately.
    """
    spark = docs.sparkSession
    table, _ = written(digests(docs, id_col, text_col), "digests")
    buckets = bucket_count(table.count(), per_bucket)
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    history, path = written(stored(grouped(table.where(early), buckets)), "history")
    after, _ = written(merge_history(history, grouped(table.where(~early), buckets)), "history")
    drop_scratch(spark, path)
    out = table.join(winners(after), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
