"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items (short texts) are partitioned by the number of their distinct 5-word shingles. In its partition an item is stored
by its MinHash sketch, the k smallest shingle fingerprints, where k = n - ceil(0.8 n) + 1 for n shingles: a document that
contains at least 0.8 of the item cannot miss all k of them, so nothing is lost however long the document is. Every
shingle of every document is looked up in the sketches of the partitions whose items fit into the document; what is found
is verified by counting all of the item's shingles in the document, first by fingerprints of 64 bits, which can miss
nothing, and then by the words themselves.

Items are handled in blocks of a bounded number of bytes; a block is broadcast, and each block takes one pass over the
documents. Items of fewer than five words are one shingle of all their words. Null or empty texts contain nothing and are
contained nowhere. Null ids stay null. Repeated documents are reported again; repeated items count as items of their own.
Empty tables give an empty result. Other columns are ignored by contaminated and kept by drop_contaminated.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_text, slices, texts_of
from .words import K, shingle_prints, word_prints, word_shingles

LEAST = 80
#: Bytes of item text in a block, and so about 16 times that in the broadcast.
BLOCK_BYTES = 4 << 20
FOUND = "doc_id long, item_id long, n_shared long, n_shingles long"


class ItemIndex:
    """Sketches and shingle sets of a block of items, for each shingle length and size partition."""

    def __init__(self, ids: list, texts: pa.Array, least: int = LEAST):
        prints, first = word_prints(texts)
        words = np.diff(first)
        self.least = least
        self.ids, self.texts, self.parts = ids, texts, []
        sets: dict[tuple[int, int], list] = {}
        for i, n_words in enumerate(words.tolist()):
            if n_words:
                k = min(K, n_words)
                own, _ = shingle_prints(prints[first[i] : first[i + 1]], np.array([0, n_words]), k, False)
                own = np.unique(own)
                sets.setdefault((k, len(own).bit_length()), []).append((i, own))
        for (k, _), rows in sorted(sets.items()):
            need = np.array([-(-least * len(s) // 100) for _, s in rows])
            keys = [s[: len(s) - n + 1] for (_, s), n in zip(rows, need)]
            owner = np.repeat(np.arange(len(rows)), [len(x) for x in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            self.parts.append({"k": k, "least": int(need.min()), "rows": [i for i, _ in rows], "sets": [s for _, s in rows], "need": need, "keys": keys[order], "owner": owner[order], "seen": np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16) > 0})

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """Text number, item number, shared and all shingles of each item that a text contains."""
        prints, first = word_prints(texts)
        out, by_k = [], {}
        self.last: tuple = (None, frozenset())  # the text whose shingles were made last
        for p in self.parts:
            if p["k"] not in by_k:
                by_k[p["k"]] = shingle_prints(prints, first, p["k"], False)
            grams, offsets = by_k[p["k"]]
            at = np.flatnonzero(p["seen"][(grams & np.uint64(0xFFFF)).astype(np.int64)])
            lo = np.searchsorted(p["keys"], grams[at])
            lo[lo == len(p["keys"])] = 0
            at = at[p["keys"][lo] == grams[at]]
            if not len(at):
                continue
            lo, hi = np.searchsorted(p["keys"], grams[at]), np.searchsorted(p["keys"], grams[at], "right")
            text = np.searchsorted(offsets, at, "right") - 1
            fits = offsets[text + 1] - offsets[text] >= p["least"]
            pairs = {(int(t), int(i)) for t, a, b in zip(text[fits], lo[fits], hi[fits]) for i in p["owner"][a:b]}
            own, own_of = None, -1
            for t, i in sorted(pairs):
                if t != own_of:
                    own, own_of = np.unique(grams[offsets[t] : offsets[t + 1]]), t
                if len(own) >= p["need"][i]:
                    if int(np.isin(p["sets"][i], own, assume_unique=True).sum()) >= p["need"][i]:
                        out += self._exact(t, p["rows"][i], p["k"], texts)
        return out

    def _exact(self, t: int, i: int, k: int, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """The pair with its counts if the item's shingles are in the text word by word."""
        if self.last[0] != (t, k):
            self.last = (t, k), word_shingles(texts[t].as_py(), k)
        asked = word_shingles(self.texts[i].as_py(), k)
        shared = len(asked & self.last[1])
        return [(t, i, shared, len(asked))] if 100 * shared >= self.least * len(asked) else []


def _search(batches, index):
    ids = index.value.ids
    for rows in batches:
        for part in slices(rows, 1, 4 << 20):
            found = index.value.find(texts_of(part.column(1)))
            doc = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array([ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], names=["doc_id", "item_id", "n_shared", "n_shingles"])


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items (item_id, text) in blocks of about so many bytes, each as lists on the driver; dealt by a hash of id and text."""
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        if got.num_rows:
            yield got.column(0).to_pylist(), texts_of(got.column(1).combine_chunks())


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles of each item that a document contains to at least ``least`` per cent."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    named = id_text(items, item_col, item_text_col).toDF("item_id", "text")
    found = [rows.mapInArrow(partial(_search, index=spark.sparkContext.broadcast(ItemIndex(ids, texts, least))), FOUND) for ids, texts in item_blocks(named, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


def _clean(batches, index, text_index: int):
    for rows in batches:
        for part in slices(rows, text_index, 4 << 20):
            keep = np.ones(part.num_rows, bool)
            keep[np.array([f[0] for f in index.value.find(texts_of(part.column(text_index)))], np.int64)] = False
            yield part.filter(pa.array(keep))


def drop_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that contain no item; one narrow pass for each block of items, columns as they were."""
    spark = docs.sparkSession
    named = id_text(items, item_col, item_text_col).toDF("item_id", "text")
    for ids, texts in item_blocks(named, block_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(ids, texts, least))
        docs = docs.mapInArrow(partial(_clean, index=index, text_index=docs.columns.index(text_col)), docs.schema)
    return docs
