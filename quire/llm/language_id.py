"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are the UTF-8 bytes of the lower-cased text, with every run of bytes that are not letters as one blank; the
n-grams of 1 to 4 bytes are hashed into BUCKETS bins for each n. The log-probability matrix (bins x languages) is
broadcast: MAX_LANGS languages at most, so 128 MB at most. A batch is scored sparsely: only the bins that occur are looked
up, and their rows of the matrix are summed text by text in numpy, which is the sparse count vector times the matrix. The n-grams of the orders overlap, so their evidence is divided by the number of orders; the
logarithm of a language's share of the labelled rows is added as its prior.

Nulls: a null text, and one without a letter (marks alone are none), is ``und`` with score 0; a null id is not held out. An empty table of labelled rows gives a model that
answers ``und`` for all. Ties go to the language that is first in alphabetical order. Other columns are ignored by
predict_language and kept by keep_languages.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, slices, texts_of

ORDERS, BUCKETS, SMOOTHING = (1, 2, 3, 4), 1 << 15, 0.5
#: Rows that length classes are pooled to before a floor of evidence is taken from them.
POOL_ROWS = 500
#: More languages than this are refused: the matrix grows with them.
MAX_LANGS = 256
#: Fixed multipliers of the rolling hash.
TIMES = np.uint32(0x01000193)
NOTHING, BLANK = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where each starts, and whether each has a letter. A text is blank, words and blanks, blank."""
    low = pc.utf8_lower(texts)
    some = pc.match_substring_regex(low, r"\pL").to_numpy(zero_copy_only=False)
    low = pc.replace_substring_regex(low, r"[^\pL\pM]+", " ")
    low = pc.binary_join_element_wise(NOTHING, pc.utf8_trim(low, " "), NOTHING, BLANK)
    flat = np.frombuffer(low.buffers()[2], np.uint8)
    begin = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    return flat[begin[0] : begin[-1]], begin[:-1] - begin[0], some


def _grams(flat: np.ndarray) -> list[np.ndarray]:
    """For each n, the bin of the n-gram that starts at each byte (the last n-1 bytes give none)."""
    out, h = [], np.zeros(len(flat), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = (h[:m] ^ flat[n - 1 :]) * TIMES
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            out.append((h & np.uint32(BUCKETS - 1)).astype(np.int64) + BUCKETS * ORDERS.index(n))
    return out


def _count(batches, langs: tuple[str, ...]):
    counts = np.zeros((len(langs), BUCKETS * len(ORDERS)), np.int64)
    number = {x: i for i, x in enumerate(langs)}
    for rows in batches:
        for part in slices(rows, 0, 1 << 20):
            names = np.array([number[x] for x in part.column(1).to_pylist()])
            texts = texts_of(part.column(0))
            for k in np.unique(names):
                flat, starts, _ = _letters(texts.filter(pa.array(names == k)))
                end = np.repeat(np.append(starts[1:], len(flat)), np.diff(np.append(starts, len(flat))))
                for n, bins in zip(ORDERS, _grams(flat)):
                    # texts stand end to end: an n-gram that reaches into the next text is none
                    counts[k] += np.bincount(bins[np.arange(len(bins)) + n <= end[: len(bins)]], minlength=counts.shape[1])
    at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(counts[at])], names=["lang", "bin", "n"])


class LanguageModel:
    def __init__(self, langs: list[str], counts: np.ndarray, rows: list[int]):
        self.langs = langs
        self.prior = np.log(np.array(rows, np.float64) / max(1, sum(rows)))
        by_order = counts.reshape(len(langs), len(ORDERS), BUCKETS).astype(np.float64) + SMOOTHING
        logs = np.log(by_order / by_order.sum(2, keepdims=True)).reshape(len(langs), len(ORDERS) * BUCKETS)
        self.matrix = np.ascontiguousarray(logs.T.astype(np.float32))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each language for each text, and whether the text has a letter."""
        p, some, _, _ = self.evidence(texts)
        return p, some

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with the log-likelihood for each byte under the best language, and the number of bytes."""
        flat, starts, some = _letters(texts)
        size = np.diff(np.append(starts, len(flat)))
        total = np.zeros((len(starts), len(self.langs)))
        if len(flat) and self.langs:
            for n, bins in zip(ORDERS, _grams(flat)):
                # of each text, from its first n-gram to the one that ends with it; a text shorter than n has none
                ends = np.append(starts[1:], len(flat)) - n + 1
                have = np.flatnonzero(ends > starts)
                if len(have):
                    edges = np.stack([starts[have], ends[have]], 1).ravel()
                    bins = np.append(bins, 0)  # so that the last end is a place too
                    for a in range(len(self.langs)):
                        total[have, a] += np.add.reduceat(np.take(self.matrix[:, a], bins), edges, dtype=np.float64)[::2]
        total /= len(ORDERS)  # n-grams of the orders overlap; their evidence counts once
        total += self.prior
        each = (total.max(1) if total.size else np.zeros(len(starts))) / np.maximum(size, 1)
        total -= total.max(1, keepdims=True) if total.size else 0
        p = np.exp(total)
        return (p / p.sum(1, keepdims=True) if p.size else p), some & bool(self.langs), each, size


def fit(labelled: DataFrame, fit_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts are summed in each task and then over tasks; the driver gets one row for each bin and language at most. All
    labelled rows are counted; with fit_rows, about so many, drawn by language and a hash of the id."""
    rows = labelled.select(col(labelled, id_col).alias("doc_id"), col(labelled, text_col).cast("string").alias("text"), col(labelled, lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    langs, total = sorted(sizes), sum(sizes.values())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} values of {lang_col}; a model learns {MAX_LANGS} languages at most")
    if not langs:
        return LanguageModel([], np.zeros((0, BUCKETS * len(ORDERS))), [])
    if fit_rows is not None and fit_rows < total:
        # the sample is shared out evenly; a language with fewer rows than its part gives them all
        left, cut = fit_rows, {}
        for k, x in enumerate(sorted(langs, key=sizes.get)):
            part = min(sizes[x], left / (len(langs) - k))
            cut[x] = int(part / sizes[x] * 1_000_000)
            left -= part
        cuts = F.create_map(*[F.lit(v) for x in langs for v in (x, cut[x])])
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < cuts[F.col("lang")])
    summed = rows.select("text", "lang").mapInArrow(partial(_count, langs=tuple(langs)), "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    counts = np.zeros((len(langs), BUCKETS * len(ORDERS)))
    counts[got.column("lang").to_numpy(), got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return LanguageModel(langs, counts, [sizes[x] for x in langs])


def _predict(batches, model):
    langs = model.value.langs
    for rows in batches:
        for part in slices(rows, 1, 1 << 20):
            p, some = model.value.scores(texts_of(part.column(1)))
            best = p.argmax(1) if p.size else np.zeros(len(some), np.int64)
            names = pa.array(np.array([*langs, "und"], object)[np.where(some, best, len(langs))], pa.string())
            score = np.where(some, p.max(1) if p.size else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array(score)], names=["doc_id", "lang_pred", "score"])


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_predict, model=shared), "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> "F.Column":
    """The fold that no model sees; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def length_class(size: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(size, 1)).astype(np.int32)


def _evidence(batches, model):
    for rows in batches:
        for part in slices(rows, 0, 1 << 20):
            _, some, each, size = model.value.evidence(texts_of(part.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(length_class(size)[some]), pa.array(each[some])], names=["class", "each"])


def evidence_floors(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """For each length class (log2 of bytes), the least log-likelihood for each byte of a text in a learned language.

    A model of each half of the labelled rows scores all rows of the other half, so no text is judged by its own counts. A
    floor is as far below the least of a pool of classes as that is below their mean; it never falls with length. Texts
    shorter than all of these have no floor, longer ones the last."""
    rows = labelled.where(col(labelled, text_col).isNotNull() & col(labelled, lang_col).isNotNull())
    half = F.coalesce(F.pmod(F.xxhash64(col(labelled, id_col), F.lit(11)), F.lit(2)), F.lit(0))
    scored = None
    for k in (0, 1):
        shared = labelled.sparkSession.sparkContext.broadcast(fit(rows.where(half == k), None, id_col, text_col, lang_col))
        each = rows.where(half != k).select(col(labelled, text_col).cast("string").alias("text")).mapInArrow(partial(_evidence, model=shared), "class int, each double")
        scored = each if scored is None else scored.unionByName(each)
    found = scored.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("each").alias("low"), F.sum("each").alias("total")).collect()
    floors = np.full(64, -np.inf)
    if not found:
        return floors
    # from the longest on, classes are pooled until they hold enough rows; the shortest ones are a pool of what is left
    pools: list[list] = [[]]
    for r in sorted(found, key=lambda r: -r["class"]):
        if sum(x["n"] for x in pools[-1]) >= POOL_ROWS:
            pools.append([])
        pools[-1].append(r)
    above = np.inf
    for pool in pools:
        low, mean = min(r["low"] for r in pool), sum(r["total"] for r in pool) / sum(r["n"] for r in pool)
        above = min(above, 2 * low - mean)
        floors[min(r["class"] for r in pool) :] = np.where(np.isinf(floors), above, floors)[min(r["class"] for r in pool) :]
    return floors


def _keep(batches, model, text_index: int, langs: frozenset, least: float, floors: np.ndarray | None):
    names = model.value.langs
    wanted = np.array([not langs or x in langs for x in names])
    for rows in batches:
        for part in slices(rows, text_index, 1 << 20):
            p, some, each, size = model.value.evidence(texts_of(part.column(text_index)))
            if not p.size:
                continue
            if floors is not None:
                some = some & (each >= floors[length_class(size)])
            yield part.filter(pa.array(some & (p.max(1) >= least) & wanted[p.argmax(1)]))


def keep_languages(docs: DataFrame, model: LanguageModel, langs: frozenset = frozenset(), least: float = 0.5, text_col: str = "text", floors: np.ndarray | None = None) -> DataFrame:
    """The rows whose text is in one of langs (all learned ones if empty) with at least this score; columns as they were.
    The score only compares learned languages; floors (evidence_floors) also refuse texts that are in none of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_keep, model=shared, text_index=docs.columns.index(text_col), langs=langs, least=least, floors=floors), docs.schema)
