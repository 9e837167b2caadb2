"""The pipeline's stages, each on what the one before kept, against brute force."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from quire.llm.common import MADE

from .test_operators import brute_components, brute_lines, prose, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, drops string, node string, bit long, item_id long, class string"
LINE = "this very line is printed under each and every page of the whole site"


def german(seed, n):
    rng = np.random.default_rng(seed)
    some = "der die das und nicht über schnell braun fuchs springt straße häuser möchte jahr zeit größer für mit dem einen".split()
    return " ".join(some[k] for k in rng.integers(0, len(some), n))


def tables(spark, folder, rows, items):
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "a", "b", 1, 2, "c") for i, t, lang in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    passage = prose(900, 30)
    rows = [(k, prose(k, 40 + k % 50), "en") for k in range(60)] + [(100 + k, german(k, 60), "de") for k in range(60)]
    rows += [(200 + k, f"{prose(300 + k, 50)}\n  {LINE}\t\nend {k}", "en") for k in range(8)]
    base = prose(500, 120).split(" ")
    for k in range(6):
        near = list(base)
        near[10 * k + 5] = f"edit{k}"
        rows.append((300 + k, " ".join(near), "en"))
    rows += [(400, prose(40, 200) + " " + passage + " " + prose(41, 200), "en"), (401, passage.upper(), "en"), (402, " ".join(passage.split(" ")[:12]) + " " + prose(43, 40), None)]
    rows += [(500, None, "en"), (501, "", None), (502, "12 34 !!", "en"), (503, "\n\n", None), (504, prose(1, 5000), "en"), (504, prose(1, 5000), "en"), (None, prose(77, 60), "en"), (None, prose(78, 60), None)]
    items = [(1, passage), (2, None), (3, "")]
    return rows, items, tables(spark, tmp_path_factory.mktemp("tables"), rows, items)


def kept_lines(rows):
    out = []
    for i, t, lang in rows:
        (row,) = [r for r in brute_lines(rows) if r[0] == i and r[1] == len((t or "").split("\n")) and (r[3] == t or r[2])][:1]
        out.append((i, t if not row[2] else row[3], lang))
    return out


def one_of_each(rows):
    least = {d: c for d, _, c in brute_components(rows)}
    return [r for r in rows if r[0] is None or least[r[0]] is None or r[0] <= least[r[0]]]


def clean(rows, items):
    asked = [shingles(q) for _, q in items if len(words(q)) >= 5]
    return [r for r in rows if not any(len(shingles(r[1]) & q) * 100 >= 80 * len(q) for q in asked)]


def test_stages_equal_brute_force(spark, made):
    rows, items, folder = made
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (lambda r: r, kept_lines, one_of_each, lambda r: clean(r, items), lambda r: r)):
        want = brute(want)
        docs = stage(spark, docs, folder)
        if name != "pieces":
            assert docs.columns == columns
            docs = docs.cache()
        got = collections.Counter((r.doc_id, r.text) for r in docs.collect())
        assert got == collections.Counter((i, t) for i, t, _ in want), name
    assert {r[0] for r in want} >= {402, 207, 300, None} and not {r[0] for r in want} & {400, 401, 301, 500, 502}
    assert sum(LINE in r[1] for r in want) == 1


def test_run_gives_the_last_stage_and_leaves_one_table(spark, made):
    rows, _, folder = made
    before = len(MADE)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "pieces", "n_pieces", "text"]
    got = out.collect()
    assert all(len(r.pieces) == r.n_pieces > 0 for r in got) and {r.doc_id for r in got} >= {402, 207, 300}
    assert len(MADE) <= before + 1


def test_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
