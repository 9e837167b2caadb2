"""N-gram Jaccard join: universe-partition pigeonhole over the sets of distinct 5-word shingles, verified exactly.

Method. Set sizes are dealt into overlapping size bands, so that any two sets with Jaccard >= 0.8 meet in a band. In a
band the universe of shingles is hashed into m segments. Two linked sets of sizes x and y differ in at most
(x + y) / 9 shingles, each of which spoils one segment, so they agree on at least m - (x + y) / 9 segments; those that are
empty on both sides say nothing. Each nonempty segment subset is indexed by its fingerprint. A set that has fewer shared
subsets than it must share (its quota) drops out; of the others only the rarest subsets are kept, as many as the quota
allows to leave out (the same order everywhere), and sets that share one of these are candidates. The number of segments
of a band is its allocation: enough slack over the pigeonhole bound for the empty segments that are to be expected,
measured against the number of index entries. Where slack is dear (the smallest sets) segments are larger and half of
them are made to stand one deletion: both the subset and each one-deletion neighbour are indexed. A set whose empty
segments use up its slack is looked for directly, as a query against all sets, in blocks.

Sets are held as 64-bit fingerprints of shingles, and equal sets are one node, named by a 64-bit fingerprint of the set.
Fingerprints are scrambled sums that no pattern of letters can make meet; by chance two of n different sets have one name
at a rate of n * n / 4e19, and no link is ever lost. Candidates are verified by counting. First
every node is compared with one leader of each of its groups, then all pairs that are still in different components are
compared, in blocks of nodes; so copies are not expanded into all pairs and no link between different texts is lost.
Components are found by alternating large-star and small-star steps over written tables.

Nulls: a null text is empty; an empty set has no link. A null doc_id is treated as a document of its own whose component_id
is null unless it is linked to one with an id. Repeated rows are identical sets and are reported again. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, drop_scratch, id_text, slices, texts_of, written
from .words import mixed, shingle_prints, word_prints

#: Jaccard at least NUM / DEN; sets of sizes x and y then differ in at most (DEN-NUM)/(DEN+NUM) * (x+y) = (x+y) / 9.
NUM, DEN, SPREAD = 80, 100, 9
#: Ratio of the band limits; a band reaches 1.25 times as far, so that bands overlap.
RATIO = 1.5
#: Bytes of text for each index bucket, nodes in a block of the verification, bits of the row filter.
BUCKET_BYTES, BLOCK_NODES, FILTER_BITS = 32 << 20, 4000, 24


def _feasible(m: int, low: int, top: int, deletions: bool) -> bool:
    """Whether sets of every size of the band keep a quota of one at least, six deviations below the mean."""
    for n in {*range(low, top + 1, max(1, (top - low) // 8)), top}:
        spoiled = (n + min(n * 5 // 4, top)) // SPREAD
        none = (1 - 1 / m) ** n
        if deletions:
            gone = m * none + n * (1 - 1 / m) ** (n - 1)
            deviation = math.sqrt(gone * max(0.0, 1 - gone / m))
            spoiled //= 2
        else:
            gone = m * none
            deviation = math.sqrt(max(0.0, gone + m * (m - 1) * max(0.0, 1 - 2 / m) ** n - gone * gone))
        if m - spoiled - gone - 6 * deviation < 1 and n > 4:
            return False
    return True


@lru_cache(None)
def allocation(band: int) -> tuple[int, int, bool]:
    """Largest set of a band, its number of segments, and whether its segments stand one deletion.

    The cost of a set is its index entries, where an entry that is a single shingle counts four times: any text with that
    shingle has it. The number of segments with and without deletions is the least that is feasible; the cheaper is taken.
    """
    top = math.ceil(1.25 * RATIO ** (band + 1)) - 1
    low = min(top, max(4, math.ceil(RATIO**band)))
    most, n = 2 * top // SPREAD, (low + top) // 2
    choices = []
    for deletions in (False, True) if band < 20 else (False,):
        for m in range((most + 2) // (2 if deletions else 1), 3 * top + 9):
            if _feasible(m, low, top, deletions):
                lone = n * (1 - 1 / m) ** (n - 1)
                if deletions:
                    entries, lone = m + n, lone + n * (n - 1) / m * (1 - 1 / m) ** max(0, n - 2)
                else:
                    entries = m * (1 - (1 - 1 / m) ** n)
                choices.append((entries + 3 * lone, m, deletions))
                break
    if not choices:
        choices = [(0, top, False)]
    _, m, deletions = min(choices)
    return top, m, deletions


def bands(n: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each band that occurs, the rows whose size is in it. Sizes below 4 link to equal sets only, which are one node."""
    out = []
    for b in range(0, int(math.log(max(2, n.max(initial=1)), RATIO)) + 2):
        rows = np.flatnonzero((n >= RATIO**b) & (n < 1.25 * RATIO ** (b + 1)) & (n >= 4))
        if len(rows):
            out.append((b, rows))
    return out


def distinct_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text end to end, and their offsets."""
    grams, offsets = shingle_prints(*word_prints(texts))
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(texts)))])


def ragged(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the elements of the given rows, and which of the rows each belongs to."""
    lens = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lens)
    return np.repeat(offsets[rows] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0), np.repeat(np.arange(len(rows)), lens)


def prints_of_sets(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The node of each set: a fingerprint of all its shingles; 0 for an empty set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams), dtype=np.uint64)])
        n = np.diff(offsets).astype(np.uint64)
        out = mixed(sums[offsets[1:]] - sums[offsets[:-1]] + n * np.uint64(0x9E3779B97F4A7C15))
    return np.where(n > 0, np.maximum(out, np.uint64(1)), np.uint64(0))


def signatures(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of all sets: subset fingerprint, row of the entries table, and that table (set, band, quota)."""
    n = np.diff(offsets)
    sigs, owners, table, base = [], [], [], 0
    for band, rows in bands(n):
        top, m, deletions = allocation(band)
        at, own = ragged(offsets, rows)
        g = grams[at]
        seg = ((mixed(g) >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        place = own * m + seg
        size = np.bincount(place, minlength=len(rows) * m)
        element = mixed(g ^ np.uint64(0x7F4A7C159E3779B9))
        order = np.argsort(place, kind="stable")
        filled = np.flatnonzero(size)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(element[order], np.cumsum(size[filled]) - size[filled])
            tag = (filled % m).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band + 1) * np.uint64(0xA5CB9243F0AEDD1B)
            keys = [mixed(sums + tag)]
            owner = [filled // m]
            x = n[rows]
            spoiled = (x + np.minimum(x * 5 // 4, top)) // SPREAD
            if deletions:
                stands = size[place] >= 2  # a lone element's deletion would leave nothing to index
                whole = np.zeros(len(rows) * m, np.uint64)
                whole[filled] = sums + tag
                keys.append(mixed(whole[place[stands]] - element[stands]))
                owner.append(own[stands])
                quota = (size.reshape(len(rows), m) >= 2).sum(1) - spoiled // 2
            else:
                quota = (size.reshape(len(rows), m) >= 1).sum(1) - spoiled
        sigs += keys
        owners += [o + base for o in owner]
        table.append(np.stack([rows, np.full(len(rows), band), quota], 1))
        base += len(rows)
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(table)


BLOBS = "bucket int, kind int, ids binary, owners binary, entries binary"
ROWS = "kind int, a long, b long, n long, band int, quota int, g long"


def _index(batches, buckets: int):
    """Documents and index entries of a batch, packed by bucket: one row for each batch and bucket."""
    for rows in batches:
        for part in slices(rows, 1, 5 << 20):
            grams, offsets = distinct_sets(texts_of(part.column(1)))
            node, n = prints_of_sets(grams, offsets), np.diff(offsets)
            doc = part.column(0)
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out = {"bucket": [int(ids[0] % buckets) if len(ids) else 0], "kind": [0], "ids": [ids.tobytes()], "owners": [known.tobytes()], "entries": [np.stack([node.view(np.int64), n], 1).tobytes()]}
            _, first = np.unique(node, return_index=True)  # one of equal sets is enough
            first = first[n[first] > 0]
            at, own = ragged(offsets, first)
            sigs, owner, table = signatures(grams[at], np.concatenate([[0], np.cumsum(n[first])]))
            if len(sigs):
                over = np.unique(node[first][table[table[:, 2] < 1, 0]])
                if len(over):
                    out["bucket"].append(0)
                    out["kind"].append(2)
                    out["ids"].append(over.tobytes())
                    out["owners"].append(b"")
                    out["entries"].append(b"")
                full = np.stack([node[first][table[:, 0]].view(np.int64), n[first][table[:, 0]] << 32 | table[:, 1] << 24 | np.clip(table[:, 2], 0, (1 << 24) - 1)], 1)
                where = (sigs % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                for b in range(buckets):
                    mine = order[cuts[b] : cuts[b + 1]]
                    if len(mine):
                        used, short = np.unique(owner[mine], return_inverse=True)
                        out["bucket"].append(b)
                        out["kind"].append(1)
                        out["ids"].append(sigs[mine].tobytes())
                        out["owners"].append(short.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes())
                        out["entries"].append(full[used].tobytes())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "ids": pa.array(out["ids"], pa.binary()), "owners": pa.array(out["owners"], pa.binary()), "entries": pa.array(out["entries"], pa.binary())})


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: its documents, and its index entries whose fingerprint two nodes or more have."""
    docs, sigs, nodes, infos, over = [], [], [], [], []
    for row in table.to_pylist():
        entries = np.frombuffer(row["entries"], np.int64).reshape(-1, 2)
        if row["kind"] == 2:
            over.append(np.frombuffer(row["ids"], np.int64))
        elif row["kind"] == 0:
            docs.append((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owners"], bool), entries))
        else:
            k = np.frombuffer(row["ids"], np.uint64)
            short = np.frombuffer(row["owners"], np.uint16 if len(row["owners"]) == 2 * len(k) else np.uint32)
            sigs.append(k)
            nodes.append(entries[short, 0])
            infos.append(entries[short, 1])
    out = []
    for ids, known, entries in docs:
        out.append(_rows(0, pa.array(ids, mask=~known), entries[:, 0], entries[:, 1]))
    for x in over:
        out.append(_rows(2, pa.array(x), x, np.zeros(len(x), np.int64)))
    if sigs:
        sig, node, info = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(infos)
        order = np.argsort(sig, kind="stable")
        same = sig[order][1:] == sig[order][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order = order[twice]  # the others' fingerprints are theirs alone
        order = order[np.lexsort((node[order], sig[order]))]
        sig, node, info = sig[order], node[order], info[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, info = sig[new], node[new], info[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        g = np.repeat(np.diff(np.append(start, len(sig))), np.diff(np.append(start, len(sig))))
        keep = g > 1
        out.append(_rows(1, pa.array(sig[keep].view(np.int64)), node[keep], info[keep] >> 32, info[keep] >> 24 & 255, info[keep] & (1 << 24) - 1, g[keep]))
    return pa.concat_tables(out) if out else _rows(0, pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rows(kind: int, a: pa.Array, b: np.ndarray, n: np.ndarray, band=None, quota=None, g=None) -> pa.Table:
    zero = np.zeros(len(b), np.int64)
    pick = lambda x: zero if x is None else x
    return pa.table({"kind": pa.array(np.full(len(b), kind), pa.int32()), "a": a.cast(pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "band": pa.array(pick(band), pa.int32()), "quota": pa.array(pick(quota), pa.int32()), "g": pa.array(pick(g), pa.int64())})


def kept_entries(shared: DataFrame) -> DataFrame:
    """sig, node, n after the quota: each set keeps its rarest subsets only, in an order that is the same for all sets.

    In bands with deletions, several entries may come from one segment, so the quota does not say how many entries two
    sets share; such entries all stay."""
    own = Window.partitionBy("node", "band")
    counted = shared.withColumn("has", F.count(F.lit(1)).over(own)).where(F.col("has") >= F.col("quota"))
    ranked = counted.withColumn("rank", F.row_number().over(own.orderBy("g", "sig")))
    with_deletions = [b for b in range(20) if allocation(b)[2]]
    stays = F.col("rank") <= F.col("has") - F.col("quota") + 1
    if with_deletions:
        stays = stays | F.col("band").isin(with_deletions)
    return ranked.where(stays).select("sig", "node", "n")


def row_bit():
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << FILTER_BITS))


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size with the bit of each id set; or-ed in tasks and groups, never larger."""
    words = ids.select(row_bit().alias("bit")).select(F.floor(F.col("bit") / 64).alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("x"))
    got = words.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[got.column("w").to_numpy()] = got.column("x").to_numpy()
    return bits


def _sets(batches, bits):
    """node and set of the documents whose bit is set (and of a few others)."""
    bits = bits.value
    for rows in batches:
        bit = rows.column(2).to_numpy()
        hit = (bits[bit >> 6] >> (bit & 63)) & 1 == 1
        if not hit.any():
            continue
        for part in slices(rows.filter(pa.array(hit)), 1, 4 << 20):
            grams, offsets = distinct_sets(texts_of(part.column(1)))
            node = prints_of_sets(grams, offsets)
            data = [grams[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(data, pa.binary())], names=["node", "members"])


def _linked(key, lists: pa.Table, sets: pa.Table) -> pa.Table:
    """One block: compares the listed pairs and gives a forest of the links."""
    number = {v: i for i, v in enumerate(sets.column("node").to_pylist())}
    own = [np.frombuffer(x, np.uint64) for x in sets.column("members").to_pylist()]
    size = np.array([len(x) for x in own], np.int64)
    root = list(range(len(own)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    for a, partners in zip(lists.column("a").to_pylist(), lists.column("partners").to_pylist()):
        i = number.get(a)
        if i is None:
            continue
        js = np.array([number[p] for p in partners if p in number], np.int64)
        js = js[DEN * np.minimum(size[js], size[i]) >= NUM * np.maximum(size[js], size[i])]
        mine = find(i)
        js = np.array([j for j in js.tolist() if find(j) != mine], np.int64)
        for k in range(0, len(js), 256):
            some = js[k : k + 256]
            flat = np.concatenate([own[j] for j in some])
            at = np.searchsorted(own[i], flat)
            at[at == size[i]] = 0
            hits = np.add.reduceat((own[i][at] == flat).astype(np.int64), np.cumsum(size[some]) - size[some])
            for j in some[DEN * hits >= NUM * (size[some] + size[i] - hits)].tolist():
                if find(i) != find(j):
                    root[find(j)] = find(i)
                    left.append(a)
                    right.append(j)
    names = sets.column("node")
    return pa.table({"a": pa.array(left, pa.int64()), "b": names.take(pa.array(right, pa.int64())).cast(pa.int64()) if right else pa.array([], pa.int64())})


def verified(lists: DataFrame, sets: DataFrame, blocks: int) -> DataFrame:
    """lists (a, bb, partners): node, block of the partners, and the partners. A block pair holds what its lists name."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    keyed = lists.select((block("a") * blocks + F.col("bb")).alias("key"), "a", "partners")
    named = keyed.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.array_append("partners", F.col("a"))))).alias("nodes"))
    needs = named.select(F.col("key").alias("at"), F.explode("nodes").alias("node"))
    got = needs.join(sets, "node").select("at", "node", "members")
    return keyed.groupBy("key").cogroup(got.groupBy("at")).applyInArrow(_linked, "a long, b long")


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """node, comp for every node of the edges (a, b): comp is the smallest node number it reaches."""
    spark = edges.sparkSession
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, path = written(both, "edges")
    state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after, new_path = written(small, "edges")
        was, state = state, after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(spark, path)
        now, path = after, new_path
        if was == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")), path


class _Asked:
    """A block of sets to look for among all: a linked set has one of the (n - ceil(0.8 n) + 1) smallest shingles."""

    def __init__(self, nodes: list[int], members: list[bytes]):
        self.nodes, self.sets = nodes, [np.frombuffer(x, np.uint64) for x in members]
        keys = [x[: len(x) + NUM * -len(x) // DEN + 1] for x in self.sets]
        self.keys, self.owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])


def _against(batches, asked):
    q = asked.value
    keys = np.unique(q.keys)
    for rows in batches:
        for part in slices(rows, 1, 4 << 20):
            grams, offsets = distinct_sets(texts_of(part.column(1)))
            node, left, right = prints_of_sets(grams, offsets).view(np.int64), [], []
            hit = np.flatnonzero(np.isin(grams, keys))
            for t in np.unique(np.searchsorted(offsets, hit, "right") - 1).tolist():
                own = grams[offsets[t] : offsets[t + 1]]
                for i in np.unique(q.owner[np.isin(q.keys, own)]).tolist():
                    both = int(np.isin(own, q.sets[i], assume_unique=True).sum())
                    if DEN * both >= NUM * (len(own) + len(q.sets[i]) - both) and node[t] != q.nodes[i]:
                        left.append(q.nodes[i])
                        right.append(node[t])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def direct_links(rows: DataFrame, sets: DataFrame, over: DataFrame, per_block: int = 2000) -> DataFrame | None:
    """Links of the sets whose slack was used up: each block of them is broadcast and asked of all documents."""
    wanted = sets.join(over, "node", "left_semi")
    blocks = -(-wanted.count() // per_block)
    out = None
    for b in range(blocks):
        got = wanted.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b).toArrow()
        if got.num_rows:
            asked = rows.sparkSession.sparkContext.broadcast(_Asked(got.column("node").to_pylist(), got.column("members").to_pylist()))
            part = rows.mapInArrow(partial(_against, asked=asked), "a long, b long")
            out = part if out is None else out.unionByName(part)
    return out


def _neighbours(table: pa.Table, blocks: int) -> pa.Table:
    """One bucket of subset groups: for each node and partner block, the partners in other components (each pair once)."""
    sig = table.column("sig").to_numpy()
    order = np.lexsort((table.column("node").to_numpy(), sig))
    sig, node, comp, n, block = sig[order], *(table.column(c).to_numpy()[order] for c in ("node", "comp", "n", "block"))
    cuts = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig))
    found: dict[tuple[int, int], set] = {}
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        for i in range(lo, hi - 1):
            rest = slice(i + 1, hi)
            ok = (comp[rest] != comp[i]) & (DEN * np.minimum(n[rest], n[i]) >= NUM * np.maximum(n[rest], n[i]))
            for p, b in zip(node[rest][ok].tolist(), block[rest][ok].tolist()):
                found.setdefault((int(node[i]), b), set()).add(p)
    return pa.table({"a": pa.array([k[0] for k in found], pa.int64()), "bb": pa.array([k[1] for k in found], pa.int64()), "partners": pa.array([sorted(v) for v in found.values()], pa.list_(pa.int64()))})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, -(-total // BUCKET_BYTES))
    blobs = rows.mapInArrow(partial(_index, buckets=buckets), BLOBS)
    stage, stage_path = written(blobs.groupBy("bucket").applyInArrow(_shared, ROWS), "subset-index")
    nodes = stage.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "n")
    shared = stage.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node"), "n", "band", "quota", "g")
    kept, kept_path = written(kept_entries(shared.where("quota > 0")), "kept-entries")

    over = stage.where("kind = 2").select(F.col("a").alias("node")).distinct()
    involved = kept.select("node").unionByName(over).distinct()
    reps = nodes.join(involved, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    reps, reps_path = written(reps, "representatives")
    count = reps.count()
    blocks = max(4, -(-count // BLOCK_NODES))
    bits = spark.sparkContext.broadcast(_filter_bits(reps))
    sets = rows.withColumn("bit", row_bit()).mapInArrow(partial(_sets, bits=bits), "node long, members binary").join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets, sets_path = written(sets, "sets")

    block = F.pmod(F.xxhash64("b"), F.lit(blocks))
    leaders = kept.groupBy("sig").agg(F.min("node").alias("lead"))
    star = kept.join(leaders, "sig").where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    lists = star.groupBy("a", block.alias("bb")).agg(F.collect_list("b").alias("partners"))
    links, links_path = written(verified(lists, sets, blocks), "star-links")
    comps, comps_path = components(links)

    labelled = kept.join(comps, "node", "left").select("sig", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed_groups = labelled.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    open_rows = labelled.join(mixed_groups, "sig", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))).withColumn("bucket", F.pmod(F.xxhash64("sig"), F.lit(4 * buckets)))
    pairs = open_rows.groupBy("bucket").applyInArrow(lambda t: _neighbours(t, blocks), "a long, bb long, partners array<long>")
    lists2 = pairs.groupBy("a", "bb").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    more, more_path = written(verified(lists2, sets, blocks), "more-links")
    direct = direct_links(rows, sets, over)
    edges = links.unionByName(more)
    final, _ = components(edges if direct is None else edges.unionByName(direct))
    drop_scratch(spark, kept_path, sets_path, reps_path, links_path, comps_path, more_path)

    grouped = nodes.join(final, "node", "left").select("doc_id", "n", "node", F.coalesce("comp", "node").alias("comp"))
    # both sides of the join are read from tables, so that the rows of a very large component can be split over tasks
    grouped, _ = written(grouped, "members")
    smallest, _ = written(grouped.groupBy("comp").agg(F.min("doc_id").alias("least")), "components")
    out = grouped.join(smallest, "comp")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked to one of a smaller id; columns as they were, rows without id stay."""
    found = jaccard_components(docs, id_col, text_col)
    gone = found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, col(docs, id_col).cast("long") == gone["__gone"], "left_anti")
