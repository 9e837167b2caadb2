"""Each operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import gzip
import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, exact_dedup, html_extract, language_id, line_dedup, ngram_join, pieces, token_counts, token_output, warc
from quire.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, keep_id long, kept string, drops string, bit long, node string, n_tokens string"
WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliett", "kilo", "lima", "mike", "november"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{b}" for a, b in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n)))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "x", "y", 1, "z", "w") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and equal texts."""
    base = prose(1, 60)
    near = base.split(" ")
    near[30] = "changed"
    return [
        (1, base, "en"), (2, base.replace(" ", " \t"), "en"), (3, " ".join(near), "en"), (4, None, "en"), (5, "", "en"), (6, " \n\t", None), (7, "one two", "en"), (8, "one two", "en"),
        (9, "ein 日本語 text 😀 ▁ x", "de"), (10, prose(2, 20000), "en"), (10, prose(2, 20000), "en"), (None, base, "en"), (11, prose(3, 40).upper(), "fr"), (12, prose(3, 40), "fr"), (13, "12 34 !!", "fr"), (14, "a  b \n\n c  　d <|endoftext|>", "en"),
    ]


def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(docs(spark, odd)).collect()
    norm = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t, _ in odd]
    groups = collections.defaultdict(list)
    for i, h in norm:
        groups[h].append(i)
    want = collections.Counter((i, min(x for x in groups[h] if x is not None), len(groups[h]), i == min(x for x in groups[h] if x is not None), h) for i, h in norm)
    assert collections.Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 256, (5000, 32), np.uint8)
    built = exact_dedup.PerfectHash.build(keys)
    table = exact_dedup.PerfectHash.load(*built.packed())
    assert sorted(table.slots(keys).tolist()) == list(range(5000)) and (table.slots(keys) == built.slots(keys)).all()
    assert (exact_dedup.PerfectHash.build(keys[:0]).slots(keys) == -1).all()


def test_history_merge(spark):
    first = exact_dedup.grouped(exact_dedup.digests(docs(spark, [(5, "a", None), (6, "b", None)])), 4)
    second = exact_dedup.grouped(exact_dedup.digests(docs(spark, [(1, "a", None), (9, "c", None), (8, "c", None)])), 4)
    history = exact_dedup.stored(first)
    found = {(r.old_keep, r.old_n) for r in exact_dedup.lookup(history, second).collect()}
    assert found == {(5, 1)}
    after = exact_dedup.merge_history(history, second)
    assert {(r.keep_id, r.group_size) for r in exact_dedup.winners(after).collect()} == {(1, 2), (6, 1), (8, 2)}
    again = exact_dedup.merge_history(after, second)
    assert {(r.keep_id, r.group_size) for r in exact_dedup.winners(again).collect()} == {(1, 3), (6, 1), (8, 4)}


def test_token_output_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    shards = token_output.write_sequences(docs(spark, odd), "file://" + str(tmp_path), path, seq_len=16, batch=3)
    got = sorted(map(tuple, token_output.read_digests(spark, shards).collect()), key=lambda r: r[1])
    tok = Tokenizer.from_file(path)
    ids = collections.Counter()
    for i, t, _ in odd:
        e = tok.encode(t or "", add_special_tokens=False).ids + [0]
        ids[i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())] += 1
    assert collections.Counter((i, n, c) for i, _, n, c in got) == ids
    starts = np.cumsum([0] + [r[2] for r in got])
    assert [r[1] for r in got] == starts[:-1].tolist()
    order = [r[0] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    flat, mask = [], []
    for s in shards:
        file = token_output.SequenceFile(s["ids_path"])
        n = -(-s["n_tokens"] // 16)
        rows = [file.sequence(k) for k in range(n)]
        flat += np.concatenate([r[0] for r in rows])[: s["n_tokens"]].tolist()
        mask += [int(sum(r[1].sum() for r in rows)) == s["n_tokens"]]
    assert len(flat) == starts[-1] and all(mask)
    assert token_output.token_output(docs(spark, []), path).count() == 0


def test_ids_are_the_library_s_in_any_batch():
    from tokenizers import Tokenizer

    from quire.llm.tokens import ByteBpe

    path = tokenizer_path()
    plain, bpe = Tokenizer.from_file(path), ByteBpe(path)
    rng = np.random.default_rng(5)
    spaces = [" "] * 6 + list("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff\x00")
    others = ["a", "b", "Z", "1", "23", "é", "日本", "٣", "'s", "'", "!?", "...", "_", "😀", "e\u0301", "<|endoftext|>", "<|endof", "don't", "word", "Ⅷ", "²"]
    texts = ["a 1\n", " ", "a 1\u3000", " ", "x 1\n y", "  ", "a<|endoftext|>b", "", " <|endoftext|>  "]
    for _ in range(10_000):
        n = int(rng.integers(0, 9))
        texts.append("".join(spaces[a] if u < 0.45 else others[b] for u, a, b in zip(rng.random(n), rng.integers(0, len(spaces), n), rng.integers(0, len(others), n))))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]

    def cut(batch):
        ids, counts = bpe.encode(pa.array(batch, pa.large_string()))
        ends = np.cumsum(counts).tolist()
        return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]

    assert cut(texts) == want
    assert [x for k in range(0, len(texts) - 1, 2) for x in cut(texts[k : k + 2])] == want[: len(texts) // 2 * 2]
    assert [x for t in texts[:1500] for x in cut([t])] == want[:1500]


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    lens = np.array([len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd])
    sums = token_counts.token_counts(docs(spark, odd), tokenizer_path())
    got = {r.n_tokens: r for r in sums.collect()}
    assert sorted(got) == sorted(set(lens.tolist()))
    for n, r in got.items():
        assert (r.n_docs, r.docs_ge, r.tokens_ge, r.tokens_below, r.tokens_cut_here, r.docs_le) == ((lens == n).sum(), (lens >= n).sum(), lens[lens >= n].sum(), lens[lens < n].sum(), np.minimum(lens, n).sum(), (lens <= n).sum())
    for limit in (0, 3, 100, 10**7):
        assert token_counts.truncated_total(sums, limit).first()[0] == np.minimum(lens, limit).sum()
    assert token_counts.length_quantile(sums, 0.5).first()[0] == sorted(lens)[int(np.ceil(len(lens) * 0.5)) - 1]
    none = token_counts.token_counts(docs(spark, []), tokenizer_path())
    assert none.count() == 0 and token_counts.truncated_total(none, 5).first()[0] == 0 and token_counts.length_quantile(none, 0.5).first()[0] is None


def test_language_id(spark, odd):
    train = [(i, f"the quick brown fox and the {prose(i, 5)}", "en") for i in range(20)] + [(100 + i, f"der schnelle braune fuchs und das über {i}", "de") for i in range(20)] + [(200, None, "fr"), (201, "text", None)]
    model = language_id.fit(docs(spark, train))
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict_language(docs(spark, [*odd, (50, "the brown fox", None), (51, "das braune über", None)]), model).collect()}
    assert got[50].lang_pred == "en" and got[51].lang_pred == "de"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 13))
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_languages(docs(spark, odd), model, least=0.0)
    assert kept.columns == docs(spark, []).columns and kept.count() == len(odd) - 4
    empty = language_id.fit(docs(spark, []))
    assert {r.lang_pred for r in language_id.predict_language(docs(spark, odd), empty).collect()} == {"und"}
    assert language_id.predict_language(docs(spark, []), model).count() == 0


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_texts_in_no_learned_language_are_refused(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rng = np.random.default_rng(3)
    junk = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4000)), " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(400)), "съешь же ещё этих мягких французских булок да выпей чаю " * 20, "鳥啼花落水空流 山高月小水落石出 " * 40]
    odd = spark.createDataFrame([(-1 - k, x) for k, x in enumerate(junk)], "doc_id long, text string")
    kept = corpus_pipeline.keep_known_languages(spark, table.unionByName(odd, allowMissingColumns=True), SF_DIR)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    lettered = {r.doc_id for r in table.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert ids == lettered


def brute_scores(train, text, langs):
    """Naive Bayes with plain dictionaries of hashed n-grams."""

    def grams(t):
        raw = (" " + re.sub(r"(?:[^\w]|[\d_])+", " ", t.lower()).strip() + " ").encode()
        for n in language_id.ORDERS:
            for k in range(len(raw) - n + 1):
                h = 0
                for c in raw[k : k + n]:
                    h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                    h ^= h >> 15
                yield n, h % language_id.BUCKETS

    counts = {x: collections.Counter() for x in langs}
    rows = collections.Counter()
    for t, x in train:
        counts[x].update(grams(t))
        rows[x] += 1
    total = {}
    for x in langs:
        size = collections.Counter()
        for (n, _), c in counts[x].items():
            size[n] += c
        total[x] = np.log(rows[x] / len(train)) + sum(np.log((counts[x][g] + language_id.SMOOTHING) / (size[g[0]] + language_id.SMOOTHING * language_id.BUCKETS)) for g in grams(text)) / len(language_id.ORDERS)
    top = max(total.values())
    p = {x: np.exp(v - top) for x, v in total.items()}
    return {x: v / sum(p.values()) for x, v in p.items()}


def test_scores_equal_a_plain_naive_bayes(spark):
    train = [("the quick brown fox", "en"), ("der schnelle braune fuchs", "de"), ("and the lazy dog", "en")]
    model = language_id.fit(docs(spark, [(k, t, x) for k, (t, x) in enumerate(train)]))
    texts = ["the fox", "der fuchs und the dog", "Über 12 Fox", "x"]
    p, some = model.scores(pa.array(texts, pa.large_string()))
    for row, text in zip(p, texts):
        want = brute_scores(train, text, model.langs)
        assert np.allclose(row, [want[x] for x in model.langs], atol=1e-4), text
        assert np.allclose(model.scores(pa.array([text], pa.large_string()))[0][0], row, atol=1e-12)  # in any batch
    assert some.all()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_held_out_accuracy(spark):
    from quire.llm.queries import op4_language_id

    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, SF_DIR).join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_a_rare_language_is_learned_from_all_its_rows(spark):
    rows = [(k, "the quick brown fox and the dog", "en") for k in range(400)] + [(1000 + k, "der schnelle braune fuchs und das über", "de") for k in range(4)]
    few = language_id.fit(docs(spark, rows), fit_rows=20)
    got = {r.doc_id: r for r in language_id.predict_language(docs(spark, [(1, "der fuchs und das über", None), (2, "the fox and the dog", None)]), few).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("de", "en")


def test_floors_of_evidence_come_from_all_labelled_rows(spark):
    plain = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the quick brown fox").alias("text"), F.lit("en").alias("lang"))
    odd = lambda k: plain.withColumn("text", F.when(F.col("doc_id") == k, "qzj xvk wjq zzx qqq").otherwise(F.col("text")))
    least = language_id.length_class(np.array([19]))[0]
    usual = language_id.evidence_floors(plain)[least]
    for k in (1, 2, 3):
        assert language_id.evidence_floors(odd(k))[least] < usual - 1


def test_patterns_of_letters_do_not_make_words_meet(spark):
    morse = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = morse.translate({97: 98, 98: 97})
    far = "x" * 10_000
    swapped = "y" + far[1:4096] + "z" + far[4097:]
    again = "z" + far[1:4096] + "y" + far[4097:]
    rows = [(k, " ".join([w] * 5), None) for k, w in enumerate((morse, other, swapped, again, far))]
    assert [r.component_id for r in sorted(ngram_join.jaccard_components(docs(spark, rows)).collect())] == [0, 1, 2, 3, 4]
    items = spark.createDataFrame([(9, rows[0][1]), (10, rows[2][1])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), items).collect()) == [(0, 9), (2, 10)]


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(t, k=5):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_decontamination(spark, odd):
    passage = prose(77, 40)
    rows = [*odd, (30, prose(5, 3000) + " " + passage + " " + prose(6, 3000), None), (31, passage.upper(), None), (32, " ".join(passage.split(" ")[:20]), None), (33, "intro one two three", None)]
    items = [(1, passage, 0), (2, "one TWO", 0), (3, None, 0), (4, "", 0), (2, "one TWO", 0)]
    table = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    got = collections.Counter(map(tuple, decontaminate.contaminated(docs(spark, rows), table).collect()))
    want = collections.Counter()
    for i, t, _ in rows:
        for j, q, _ in items:
            k = min(5, len(words(q)))
            if k:
                own, asked = shingles(t, k) if len(words(t)) >= k else frozenset(), shingles(q, k)
                n = len(own & asked)
                if n * 100 >= 80 * len(asked):
                    want[i, j, n, len(asked)] += 1
    assert got == want and any(x[0] == 30 for x in got)
    small = decontaminate.contaminated(docs(spark, rows), table, block_bytes=64)
    assert collections.Counter(map(tuple, small.collect())) == want
    bad = {x[0] for x in want}
    clean = decontaminate.drop_contaminated(docs(spark, rows), table)
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, _, _ in rows if i not in bad)
    assert decontaminate.contaminated(docs(spark, rows), table.limit(0)).count() == 0 and decontaminate.contaminated(docs(spark, []), table).count() == 0


def brute_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows))


def test_ngram_join(spark, odd):
    rng = np.random.default_rng(4)
    rows = list(odd)
    for g in range(12):
        n = int(rng.integers(4, 200))
        base = prose(100 + g, n).split(" ")
        for k in range(int(rng.integers(2, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, max(1, n // 40) + 1))):
                w[int(rng.integers(0, n))] = f"edit{rng.integers(0, 1000)}"
            rows.append((1000 + g * 20 + k, " ".join(w), None))
    got = collections.Counter(map(tuple, ngram_join.jaccard_components(docs(spark, rows)).collect()))
    assert got == brute_components(rows)
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    kept = ngram_join.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    gone = {d for d, _, c in brute_components(rows) if d is not None and c is not None and d > c}
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(d for d, _, _ in rows if d not in gone)


def test_direct_links_find_what_the_index_would_lose(spark):
    base = prose(9, 80)
    near = base.replace(" ", " x ", 1)
    rows = docs(spark, [(1, base, None), (2, near, None), (3, prose(8, 80), None)]).select("doc_id", "text")
    sets = []
    for t in (base, near):
        g, o = ngram_join.distinct_sets(pa.array([t], pa.large_string()))
        sets.append((int(ngram_join.prints_of_sets(g, o).view(np.int64)[0]), bytearray(g.tobytes())))
    table = spark.createDataFrame(sets[:1], "node long, members binary")
    got = {tuple(r) for r in ngram_join.direct_links(rows, table, table.select("node")).collect()}
    assert got == {(sets[0][0], sets[1][0])}


def test_allocation_uses_deletions_where_cheaper():
    kinds = {ngram_join.allocation(b)[2] for b in range(2, 16)}
    assert kinds == {True, False}


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda s: s.strip(strip).translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for d, t, _ in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                held[key(s)].add(d)
    out = collections.Counter()
    for d, t, _ in rows:
        ls = (t or "").split("\n")
        keep = [s for s in ls if not (len(held[key(s)]) >= 5 and d != max(x for x in held[key(s)] if x is not None))]
        out[d, len(ls), len(ls) - len(keep), "\n".join(keep)] += 1
    return out


def test_line_dedup(spark, odd):
    line = "A very Common line of text that is É long enough"
    rows = [*odd, *[(20 + i, f"own {i}\n  {line if i % 2 else line.replace('V', 'v')}\t\n{line}\n\nend", None) for i in range(9)], (40, line, None), (None, line, None), (41, "short line\n" * 9, None)]
    for batches in (1, 3, 5):
        got = collections.Counter(map(tuple, line_dedup.line_report(docs(spark, rows), batches).collect()))
        assert got == brute_lines(rows)
    clean = line_dedup.drop_lines(docs(spark, rows))
    assert clean.columns == docs(spark, []).columns
    want = collections.Counter((d, t) for (d, _, _, t), n in brute_lines(rows).items() for _ in range(n))
    assert collections.Counter((r.doc_id, r.text or "") for r in clean.collect()) == want
    assert line_dedup.line_report(docs(spark, [])).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    line = "one line of more than forty characters in two documents"
    rows = [*[(10, f"{line}\nown", None)] * 4, (11, line, None)]
    nulls = [*[(None, f"{line} null\nown", None)] * 4, (12, f"{line} null", None)]
    five = [*[(20, f"{line} five", None)] * 3, *[(k, f"{line} five", None) for k in range(21, 25)]]
    for batches in (1, 3):
        got = collections.Counter(map(tuple, line_dedup.line_report(docs(spark, [*rows, *nulls, *five]), batches).collect()))
        assert got == brute_lines([*rows, *nulls, *five])
        assert {d: n for d, _, n, _ in got} == {10: 0, 11: 0, None: 0, 12: 0, 20: 1, 21: 1, 22: 1, 23: 1, 24: 0}


def test_pieces_are_lossless_and_reproducible(spark, odd):
    path = tokenizer_path("piece_bpe_32k.model")
    got = pieces.encode_pieces(docs(spark, odd), path).collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in got) == collections.Counter((i, t or "") for i, t, _ in odd)
    again = pieces.encode_pieces(docs(spark, odd).repartition(5), path).collect()
    assert collections.Counter((r.doc_id, tuple(r.pieces)) for r in again) == collections.Counter((r.doc_id, tuple(r.pieces)) for r in got)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert all(model.decode(list(r.pieces)) == r.decoded for r in got if "\x00" not in r.decoded)
    assert pieces.piece_digests(docs(spark, []), path).count() == 0
    assert pieces.piece_digests(docs(spark, odd), path).where("not lossless").count() == 0


def test_long_words_and_characters_without_a_piece():
    import time

    model = pieces.PieceLattice(tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    cjk = "".join(chr(0x4E00 + c) for c in rng.integers(0, 20_000, 32_000))
    run = "".join(chr(97 + c) for c in rng.integers(0, 26, 100_000))
    texts = [cjk, run, "▁" * 2000, "a▁b ▁", "日▁" * 50 + run[:700], "\x00", " ", "  x", run[:511] + " " + run[:514]]
    keys = np.arange(len(texts))
    ids, counts = model.encode(pa.array(texts), keys)
    assert [x.decode() for x in model.decode(ids, counts)] == texts
    began = time.process_time()
    model.encode(pa.array([cjk[::-1]]), np.zeros(1))
    assert time.process_time() - began < 1
    ends = np.cumsum(counts)
    for k, t in enumerate(texts):  # in any batch the same
        assert model.encode(pa.array([t]), keys[k : k + 1])[0].tolist() == ids[ends[k] - counts[k] : ends[k]].tolist()
    # a long segment is filtered as a short one is
    source, target, piece = np.array([0, 1, 0, 2, 1, 3]), np.array([1, 2, 2, 3, 3, 4]), np.array([300, 310, 320, 330, 340, 350])
    whole = model._shares(source, target, piece, np.zeros(6, np.int64), np.array([0]), np.array([4]))
    alone = model._long_shares(source.tolist(), target.tolist(), model.weight[piece].tolist(), 4)
    assert np.allclose(whole, alone)


def test_sampling_follows_the_lattice():
    model = pieces.PieceLattice(tokenizer_path("piece_bpe_32k.model"))

    def paths(s):
        if not s:
            yield (), 1.0
        for j in range(1, len(s) + 1):
            if s[:j] in model.ids:
                for rest, p in paths(s[j:]):
                    yield (model.ids[s[:j]], *rest), p * model.weights[model.ids[s[:j]]]

    n = 4000
    share = dict(paths("▁under"))
    total = sum(share.values())
    ids, counts = model.encode(pa.array(["under"] * n), np.arange(n))
    ends = np.cumsum(counts)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends))
    assert set(seen) <= set(share) and all(abs(seen[k] / n - v / total) < 0.03 for k, v in share.items())


PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li>Two</ul></nav><div class=\"ad\">Buy</div>{}<div id='comments'>nice</div><footer>&copy; x</footer></body></html>"


def test_html(spark):
    rows = [
        (1, "http://a.example/1", PAGE.format("<article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>four&lt;five&#33;</p><aside>side</aside><form>f</form></article>"), "x"),
        (2, "http://a.example/2", PAGE.format("<article><p>Only</p><!-- no --></article>"), "x"),
        (3, "http://A.example/3", None, "x"), (4, "http://a.example/4", "", "x"), (5, None, "<p>loose <i>text</i>", "x"), (1, "http://a.example/1", PAGE.format("<article><p>again"), "x"),
        (6, "http://b.example/", "<body><div class=menu>m m m</div><div class=story><p>Long story one here</p></div>", "x"), (7, "http://b.example/2", "<body><div class=menu>m m m</div><div class=story><p>Another long story</p></div>", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.main_text(pages).collect())
    want = [(1, "Head & more One two three four<five!"), (1, "again"), (2, "Only"), (3, ""), (4, ""), (5, "loose text"), (6, "Long story one here"), (7, "Another long story")]
    assert [(a, b) for a, b, _ in got] == want and all(n == len(t) for _, t, n in got)
    joined = html_extract.main_text(pages, broadcast_bytes=0)
    assert sorted((r.page_id, r.text, r.n_chars) for r in joined.collect()) == got
    assert html_extract.main_text(pages.limit(0)).count() == 0


def texts_on(spark, pages):
    rows = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_extract.main_text(rows).collect())]


def test_html_keeps_all_blocks_of_an_unnamed_article(spark):
    menu = "<body><div class=top><ul><li>Home</li><li>News</li></ul></div>"
    story = lambda k: f"<div class=story id=post-{k}><h1>Head {k}</h1><p>short {k}<ul><li>a long item of page {k} and more</li></ul><blockquote>quote {k}</blockquote><table><tr><td>cell {k}</table></div>"
    want = lambda k: f"Head {k} short {k} a long item of page {k} and more quote {k} cell {k}"
    assert texts_on(spark, [menu + story(k) for k in range(4)]) == [want(k) for k in range(4)]
    parts = lambda k: "<div class=story>" + "".join(f"<section class=s{c}><p>part {c} of {k}</p></section>" for c in "abcdefghijkl") + "</div>"
    assert texts_on(spark, [menu + parts(k) for k in range(4)]) == [" ".join(f"part {c} of {k}" for c in "abcdefghijkl") for k in range(4)]
    # no element holds the article: the body does, without its constant children
    loose = lambda k: f"<h1>Head {k}</h1><p>text {k}</p><ul><li>item {k}</li></ul><div class=end>all rights</div>"
    assert texts_on(spark, [menu + loose(k) for k in range(4)]) == [f"Head {k} text {k} item {k}" for k in range(4)]
    assert texts_on(spark, ["<body><div class=x><p>same</p><ul><li>list</li></ul></div>"] * 4) == ["same list"] * 4


def test_html_drops_furniture_by_whole_marks_only(spark):
    body = "<article><h2 id=side-effects>Side effects</h2><section id=related-work class=social-history><p>Work</p></section><div id=search-algorithms>Search</div><p><math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> and <object>figure text</object></p><div class='box share'>Share</div><div class=share-buttons>Tweet</div><div role=navigation>Go</div><div id=comments>nice</div></article>"
    assert texts_on(spark, ["<body><article class=promo-card>Teaser</article>" + body]) == ["Side effects Work Search x = 1 and figure text".replace("x = 1", "x=1")]


def wrapper_of(spark, pages):
    found, _ = html_extract.wrappers(spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3))
    return found.first()


def test_wrapper_inference(spark):
    item = lambda n, extra="": "<body><ul>" + "<li>x</li>" * n + f"</ul>{extra}<article><p>t</p></article></body>"
    got = html_extract.expression(html_extract.loaded(json.loads(wrapper_of(spark, [item(3), item(7), item(2, "<div class=ad>a</div>")]).wrapper)))
    assert got == "<html><body><ul>(<li>#</li>)+</ul>(<div.ad>#</div>)?<article><p>#</p></article></body></html>"
    # neighbouring optional groups meet plain tokens one by one, and repeated runs fold
    parts = lambda *names: "<body>" + "".join(f"<{n}>x</{n}>" for n in names) + "</body>"
    got = html_extract.expression(html_extract.loaded(json.loads(wrapper_of(spark, [parts("h1", "pre", "ul"), parts("h1", "ul"), parts("h1")]).wrapper)))
    assert got == "<html><body><h1>#</h1>(<pre>#</pre>)?(<ul>#</ul>)?</body></html>"
    got = html_extract.expression(html_extract.loaded(json.loads(wrapper_of(spark, [parts("h1", "h2", "p", "h2", "p", "p"), parts("h1", "h2", "p")]).wrapper)))
    assert got == "<html><body><h1>#</h1>(<h2>#</h2>(<p>#</p>)+)+</body></html>"


def site(seed, pages):
    """Pages of a site whose marks say nothing, and the text of each article."""
    rng = np.random.default_rng(seed)
    mark = [f"k{''.join(chr(97 + c) for c in rng.integers(0, 26, 6))}" for _ in range(8)]
    out = []
    for k in range(pages):
        blocks = [("h1", f"title {prose(seed * 1000 + k, 4)}"), *[(["p", "p", "p", "blockquote", "h2"][rng.integers(0, 5)], prose(seed * 10_000 + k * 100 + j, int(rng.integers(12, 40)))) for j in range(int(rng.integers(3, 9)))]]
        body = "".join(f"<{n}>{t.replace(' ', ' <b>', 1)}</b></{n}>" for n, t in blocks)
        body += "<ul>" + "".join(f"<li>{prose(k * 7 + j, 9)}</li>" for j in range(k % 4)) + "</ul>" if k % 4 else ""
        text = " ".join([t for _, t in blocks] + [prose(k * 7 + j, 9) for j in range(k % 4)])
        menu = f"<div class={mark[0]}><ul>" + "".join(f"<li><a href=/{j}>{prose(j, 2)}</a></li>" for j in range(5 + k % 3)) + "</ul></div>"
        legal = f"<div class={mark[3]}><p>{prose(seed, 30)}</p></div>"
        other = f"<div class={mark[5]}>" + "".join(f"<a href=/o{j}>{prose(k * 31 + j, 6)}</a> " for j in range(k % 5)) + "</div>" if k % 2 else ""
        note = f"<div class={mark[6]}>{prose(seed + 5, 6)}</div>"
        out.append((f"<html><body>{menu}<div class='{mark[1]} x{k}'><div class={mark[2]} id=post-{k}>{body}{note}</div></div>{other}{legal}</body></html>", text))
    return out


def test_wrapper_decides_where_marks_say_nothing(spark):
    for seed in range(3):
        made = site(seed, 40)
        assert texts_on(spark, [p for p, _ in made]) == [t for _, t in made]
    page, text = site(1, 40)[5]
    alone = texts_on(spark, [page])[0]
    assert alone != text and text in alone  # without other pages of the host the constant note is not known


def test_html_texts_do_not_depend_on_partitions_or_parts(spark):
    pages = [p for p, _ in site(7, 30)] + ["<body><div class=zz>" + "".join(f"<p>{prose(k, 12)}</p><hr><table><tr><td>{k}</table>" for k in range(n)) + "</div>" for n in range(6)]
    rows = spark.createDataFrame([(k, "http://h.example/", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    want = sorted(html_extract.main_text(rows.coalesce(1)).collect())
    assert sorted(html_extract.main_text(rows.repartition(11)).collect()) == want
    assert wrapper_of(spark, pages).wrapper == wrapper_of(spark, pages[::-1]).wrapper


def test_html_copies_of_one_page_keep_their_text(spark):
    page = "<body><div class=q><h1>Head</h1><p>one text here</p><div class=r>inner text</div></div></body>"
    assert texts_on(spark, [page] * 5) == ["Head one text here inner text"] * 5


def test_html_very_deep_and_very_long(spark):
    deep = "<body>" + "<div class=a>" * 3000 + "deep text" + "</div>" * 3000 + "</body>"
    long = "<body><article>" + "<p>some words</p>" * 20_000 + "</article></body>"
    got = texts_on(spark, [deep, long, "<article>a <label>b</label> <dialog>c</dialog></article>", "<<<", "a<b", "<p", "&#xD800;&amp", "<div" * 50])
    assert got[0] == "deep text" and got[1] == " ".join(["some words"] * 20_000) and got[2] == "a b c" and got[4] == "a<b"


def test_html_furniture_at_any_depth_and_of_whole_blocks_only(spark):
    deep = lambda n, inside: "<article><p>Body text here.</p>" + "<div>" * n + inside + "</div>" * n + "</article>"
    menu = "<nav><ul><li>MENU</li></ul></nav>"
    pages = [deep(n, menu) for n in (20, 199, 220, 2000)] + [deep(300, menu + "after")]
    assert texts_on(spark, pages) == ["Body text here."] * 4 + ["Body text here. after"]
    marked = "<article><header><h1>Title</h1></header><p class=notice>one</p><p class=share>two <span class=search>three</span></p><table class=search><tr><td class=ad>four</td></tr></table><noscript>five</noscript><div class=ad>AD</div></article><header>SITE</header>"
    assert texts_on(spark, [marked]) == ["Title one two three four five"]


def test_html_comments_are_known_by_their_records(spark):
    def page(k, marks):
        body = "".join(f"<p>{prose(k * 7 + j, 40)}</p>" for j in range(2 + k % 2))
        said = "".join(f"<div class={marks}><div class=u>{prose(k * 50 + j, 1)}</div><div class=v>{1 + j} May</div><p>{prose(k * 90 + j, 20)}</p></div>" for j in range(1 + k % 4))
        return f"<body><main>{body}<div class=zz>{said}</div></main></body>", " ".join(prose(k * 7 + j, 40) for j in range(2 + k % 2))

    made = [page(k, "q7x") for k in range(12)]
    assert texts_on(spark, [h for h, _ in made]) == [t for _, t in made]
    steps = "<main><p>intro</p>" + "".join(f"<div class=s><h3>Step {k}</h3><p>do {k}</p><p>{prose(k, 30)}</p></div>" for k in range(4)) + "</main>"
    assert all(prose(k, 30) in texts_on(spark, [steps])[0] for k in range(4))  # records with headings are sections


def test_html_many_siblings_in_little_time():
    import time

    rng = np.random.default_rng(1)
    kinds = ["<p>a</p>", "<hr>x", "<div>b</div>", "<h2>c</h2>", "<table><tr><td>d</table>"]
    for n_kinds in (1, 2, 3, 5):
        page = "<article>" + "".join(kinds[k] for k in rng.integers(0, n_kinds, 20_000)) + "</article>"
        began = time.process_time()
        html_extract.parsed(page)
        assert time.process_time() - began < 5  # about 1 s; the square of the siblings took minutes
    html_extract.parsed("<p>" + "<b>x" * 20_000)


def brute_folds(labels):
    """The smallest repeat at the end is folded at once, found by trying every size."""
    out = []
    for x in labels:
        if out and out[-1] == x or out and out[-1][0] == "(" and out[-1][1:-1].split(" ")[-1] == x:
            continue
        out.append(x)
        for size in range(2, len(out)):
            unit = out[-size:]
            if out[-1 - size] == "(" + " ".join(unit) + ")":
                del out[-size:]
            elif len(out) >= 2 * size and unit == out[-2 * size : -size]:
                out[-2 * size :] = ["(" + " ".join(unit) + ")"]
            else:
                continue
            break
    return out


def test_folds_equal_trying_every_size():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        labels = ["p", "hr", "div", "ul", "h2"]
        labels = [labels[k] for k in rng.integers(0, 2 + seed % 4, rng.integers(1, 200))]
        if seed % 3 == 0:
            labels = labels[:9] * 5 + labels[3:12] * 4
        assert [k.label for k in html_extract.folded([html_extract.Part(x) for x in labels])] == brute_folds(labels)


def test_alignments_rise_in_both_lists(monkeypatch):
    monkeypatch.setattr(html_extract, "SMALL", 16)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        a = [str(x) for x in rng.integers(0, 2 + seed % 9, 120)]
        b = [x for x in a if rng.random() < 0.8] if seed % 2 else [str(x) for x in rng.integers(0, 2 + seed % 9, 90)]
        pairs = html_extract._pairs(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) >= 20 or not seed % 2


def brute_revisits(records):
    """record_id: (response_id, state, headers, digest), by looking through all records for each revisit."""
    updates = {"cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"}
    out = {}
    for r in records:
        if r["kind"] == "revisit":
            earlier = [x for x in records if x["kind"] == "response" and x["status"] == 200 and x["c"] == r["c"] and x["date"] is not None and r["date"] is not None and x["date"] < r["date"]]
            if not earlier:
                out[r["record_id"]] = (None, "no-earlier-response", None, None)
                continue
            old = max(earlier, key=lambda x: (x["date"], x["record_id"]))
            a, b = old["headers"] or {}, r["headers"] or {}
            pairs = [(a.get("etag", "").removeprefix("W/") if "etag" in a else None, b.get("etag", "").removeprefix("W/") if "etag" in b else None), (a.get("last-modified"), b.get("last-modified")), (old["digest"], r["digest"])]
            known = [(x, y) for x, y in pairs if x is not None and y is not None]
            state = "no-validator" if not known else "resolved" if known[0][0] == known[0][1] else "validator-mismatch"
            merged = {**a, **{k: v for k, v in b.items() if k in updates}} if state == "resolved" and old["headers"] is not None else None
            out[r["record_id"]] = (old["record_id"], state, merged, old["digest"])
    return out


def test_warc(spark):
    import datetime

    zero = datetime.datetime(2024, 1, 1)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        url = None if k == 7 else ["http://www.A.example:80/x/", "https://a.example/x?utm_source=q#f", "http://b.example/?b=2&a=1", "http://b.example?a=1&b=2"][rng.integers(0, 4)] if k % 3 else "http://hot.example/"
        date = None if k % 50 == 9 else zero + datetime.timedelta(minutes=int(rng.integers(0, 120)))
        kind = "revisit" if rng.random() < 0.4 else "response"
        tag = ['"a"', 'W/"a"', '"b"', None][rng.integers(0, 4)]
        head = {"etag": tag, "last-modified": [None, "m1", "m2"][rng.integers(0, 3)], "content-type": f"t{k}", "cache-control": str(k), "vary": "x" if k % 2 else None, "server": f"s{k % 3}"}
        head = {x: v for x, v in head.items() if v is not None} if k % 5 else None
        rows.append((f"r{k:03}", kind, url, date, 200 if k % 11 else 404, head, ["d", "e", None][rng.integers(0, 3)], None, 1))
    rows += rows[5:25] + rows[5:25]  # repeated rows are resolved alike
    table = spark.createDataFrame(rows, warc.RECORD + ", part int")
    named = [r.asDict() for r in table.withColumn("c", warc.canonical_url(F.col("url"))).collect()]
    want = brute_revisits(named)
    found = warc.resolve_revisits(table.repartition(7)).collect()
    assert len(found) == sum(r[1] == "revisit" for r in rows)
    assert all((r.response_id, r.state, r.headers, r.digest) == want[r.record_id] for r in found)
    assert len({r.state for r in found}) == 4
    assert {c["c"] for c in named} == {"/", "hot.example/", "a.example/x", "b.example/?a=1&b=2"}
    assert warc.resolve_revisits(table.limit(0)).count() == 0


def test_warc_parsing(spark):
    data = warc.warc_record("response", "urn:1", "http://a/", "2024-01-01T00:00:00Z", "200 OK", {"ETag": "x"}, b"body\r\n\r\nmore", "sha1:1") + warc.warc_record("revisit", "urn:2", "http://a/", "2024-01-02T00:00:00Z", "304 Not Modified", {}, b"")
    rows = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-40]),), (None,), (bytearray(b""),)], "content binary")
    got = warc.parse_warc(rows).collect()
    packed = gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]) + gzip.compress(data)[:30]
    bad = data.replace(b"2024-01-01T00:00:00Z", b"the first day").replace(b"Content-Length: ", b"Content-Length: x", 1) + data.replace(b"2024-01-01T00:00:00Z", b"yesterday").replace(b"ETag: x", b"Link: a\r\nLink: b")
    more = warc.parse_warc(spark.createDataFrame([(bytearray(packed),), (bytearray(bad),), (bytearray(b"\x1f\x8bjunk"),)], "content binary")).collect()
    assert [r.record_id for r in more if r.kind == "damaged"] == ["urn:1"]
    more = [r for r in more if r.kind != "damaged"]
    assert [(r.record_id, r.date is None) for r in more] == [("urn:1", False), ("urn:2", False), ("urn:2", False), ("urn:1", True), ("urn:2", False)]
    assert more[3].headers["link"] == "a, b"
    assert [(r.record_id, r.status, bytes(r.body)) for r in got[:2]] == [("urn:1", 200, b"body\r\n\r\nmore"), ("urn:2", 304, b"")]
    assert [(r.record_id, r.kind) for r in got[2:]] == [("urn:1", "response"), ("urn:2", "damaged")]


def test_warc_damage_loses_no_other_record(spark):
    one = lambda k, body=b"body": warc.warc_record("response", f"urn:{k}", "http://a/", "2024-01-01T00:00:00Z", "200 OK", {"X": "y"}, body)
    ids = lambda data: [(r[0], r[1]) for r in warc.read_records(data)]
    ok = [(f"urn:{k}", "response") for k in range(4)]
    lost = [ok[0], ("urn:1", "damaged"), ok[2], ok[3]]
    for length in (b"Content-Length: 9000", b"Content-Length: " + b"9" * 5000, b"Content-Length: -1", b"Content-Length:"):
        damaged = re.sub(rb"Content-Length: \d+", length, one(1))
        assert ids(one(0) + damaged + one(2) + one(3)) == lost
    assert ids(one(0) + one(1).replace(b"Content-Length: ", b"Content-Length: " + b"0" * 5000) + one(2) + one(3)) == ok
    noise = np.random.default_rng(1).integers(0, 256, 40_000, np.uint8).tobytes()
    members = [gzip.compress(one(k, noise if k == 1 else b"body")) for k in range(4)]
    assert ids(b"".join(members)) == ok and ids(gzip.compress(one(0) + one(1)) + members[2] + members[3]) == ok
    for bad in (members[1][:20_000], members[1][:20_000] + b"\xff" * 50 + members[1][20_050:], members[1][:3]):
        got = ids(members[0] + bad + members[2] + members[3])
        assert [r for r in got if r[1] == "response"] == [ok[0], *ok[2:]] and ("urn:1", "damaged") in got or bad == members[1][:3]
    early = one(0).replace(b"2024-01-01T00:00:00Z", b"0001-01-01T00:00:00+14:00") + one(1).replace(b"2024-01-01T00:00:00Z", b"9999-12-31T23:59:59-14:00")
    rows = warc.parse_warc(spark.createDataFrame([(bytearray(early),), (bytearray(one(2, b"x" * 30_000_000)),)], "content binary")).collect()
    assert [r.date for r in rows[:2]] == [None, None] and len(rows[2].body) == 30_000_000
