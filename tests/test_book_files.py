"""Lines in splits, book files with their refusals, and re-binding against a fold over rows and runs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import rebind
from quire.sources import banks, book_files

HEAD = {"book": 3, "engine": "e", "language": "en", "source": {"pages": 2, "unreadable": [], "bankSha": "s"}, "chapters": [], "typography": None, "seams": [], "loose": {"markers": [], "notes": []}}


def part(src, begin, end, **more):
    return {"src": src, "page": 1, "chars": [begin, end], **more}


def row(k, text="some words", **more):
    return {"id": f"b1-{k}", "category": "Text", "text": text, "page": 1, "pages": [1], "box": {"x1": 0, "y1": 0, "x2": 1, "y2": 1}, "pageWidth": 10, "pageHeight": 10, "parts": [part("1:0", 0, len(text.encode("utf-16-le")) // 2)], **more}


def without(d, *names):
    return {k: v for k, v in d.items() if k not in names}


def read(spark, folder, files):
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    rows, heads, refused = book_files.book_files(spark, str(folder))
    name = lambda r: r.book.rsplit("/", 1)[1]
    return {(name(r), r.id): r for r in rows.collect()}, {name(r) for r in heads.collect()}, {name(r): (r.seq, r.id, r.why) for r in refused.collect()}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = {f"f{k}": [f"{k} line {n} " + "x" * (n * 7 % 90) for n in range(400 * k)] for k in range(4)}
    for name, some in lines.items():
        (tmp_path / name).write_bytes(("﻿" + "\n".join(some) + ("\n" if name == "f2" else "")).encode())
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700", "3001", "64000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got: dict = {}
            for r in banks.ordered_lines(spark, str(tmp_path)).collect():
                got.setdefault(r.book.rsplit("/", 1)[1], []).append((r.seq, r.value))
            assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in lines.items() if v}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_units_and_points(spark):
    for text in ("", "plain", "a😀b😀😀c", "😀"):
        for unit in range(len(text.encode("utf-16-le")) // 2 + 1):
            got = spark.range(1).select(X.utf16_length(F.lit(text)).alias("n"), X.point_of_unit(F.lit(text), F.lit(unit)).alias("p")).first()
            assert got.n == len(text.encode("utf-16-le")) // 2
            begun = text.encode("utf-16-le")[: 2 * unit].decode("utf-16-le", "ignore")
            assert got.p in (len(begun), len(begun) + 1)  # within a character of two units: after it
            if len(begun.encode("utf-16-le")) == 2 * unit:
                assert got.p == len(begun)


def test_sound_files_give_their_rows(spark, tmp_path):
    text = "one 😀 two"
    cut = {**row(2, text), "parts": [part("1:1", 0, 6), part("2:0", 6, 6), part("2:1", 6, 10, fused="x")], "refs": [{"block": "b1-1", "at": 1, "len": 2}], "shelf": "furniture", "why": "foot", "image": "p.png", "extra": 1}
    files = {
        "a": [HEAD, row(1), "", "  ", cut, {**row(3), "id": "e-7#2/1/2"}, {**row(4, ""), "box": None}],
        "b": ["﻿" + json.dumps({**HEAD, "book": 3.0, "figures": {"blocks": 0, "cut": 0, "from": None}, "source": {**HEAD["source"], "generation": "g"}, "seams": [{"after": "x", "before": "y"}]})],
        "c": [{**HEAD, "figures": {"blocks": 0, "cut": 0, "from": "epub"}}, {**row(1), "id": "b10-2-3"}],
    }
    rows, heads, refused = read(spark, tmp_path / "x", files)
    assert refused == {} and heads == {"a", "b", "c"} and len(rows) == 5
    got = rows["a", "b1-2"]
    assert [(p.src, p.begin, p.end, p.fused) for p in got.parts] == [("1:1", 0, 5, None), ("2:0", 5, 5, None), ("2:1", 5, 9, "x")]
    assert (got.seq, got.text, got.shelf, got.why, got.image, got.refs[0].at) == (4, text, "furniture", "foot", "p.png", 1)
    assert rows["a", "b1-1"].box.x2 == 1.0 and rows["a", "b1-4"].box is None


BAD_HEADS = {
    "header is not JSON": ["{", "", "[1] x"], "old version": [{**HEAD, "book": 1}, {**HEAD, "book": 2}], "version": [{**HEAD, "book": 4}, {**HEAD, "book": "3"}, without(HEAD, "book"), [], 7, None],
    "engine or language": [without(HEAD, "engine"), {**HEAD, "language": 5}], "source": [without(HEAD, "source"), {**HEAD, "source": {"pages": "2", "unreadable": [], "bankSha": "s"}}, {**HEAD, "source": {**HEAD["source"], "generation": None}}, {**HEAD, "source": None}],
    "chapters": [without(HEAD, "chapters"), {**HEAD, "chapters": {}}], "typography": [without(HEAD, "typography")], "seams": [without(HEAD, "seams"), {**HEAD, "seams": [{"after": "x"}]}, {**HEAD, "seams": [None]}],
    "loose": [without(HEAD, "loose"), {**HEAD, "loose": {"markers": []}}], "figures": [{**HEAD, "figures": {"blocks": 1, "cut": 1}}, {**HEAD, "figures": {"blocks": "1", "cut": 1, "from": None}}, {**HEAD, "figures": {"blocks": 1, "cut": 1, "from": "attic"}}],
}
BAD_ROWS = {
    "not JSON": ["{", json.dumps(row(5)) + "x"], "no id": [without(row(5), "id"), {**row(5), "id": ""}, {**row(5), "id": 5}, 7, None, []], "id": [{**row(5), "id": x} for x in ("b1", "b1-", "c1-1", "b1-1#", "e-", "b1-1 ", "b1-1/x", "e-1-2", "b1-1\n")],
    "repeated id": [row(1), row(2)], "text or category": [without(row(5), "text"), {**row(5), "text": 5}, without(row(5), "category")], "place": [without(row(5), "box"), {**row(5), "page": "1"}, {**row(5), "pages": 1}, without(row(5), "page")],
    "no parts": [{**row(5), "parts": []}, without(row(5), "parts"), {**row(5), "parts": {}}],
    "part": [{**row(5), "parts": [x]} for x in (None, {"src": 1, "page": 1, "chars": [0, 10]}, {"src": "1:0", "page": "1", "chars": [0, 10]}, {"src": "1:0", "page": 1, "chars": [0]}, {"src": "1:0", "page": 1, "chars": [0, "10"]}, {"src": "1:0", "page": 1, "chars": [0, 5, 10]})],
    "fused": [{**row(5), "parts": [part("1:0", 0, 10, fused=x)]} for x in (5, None, [])],
    "not divided": [{**row(5), "parts": x} for x in ([part("a", 1, 10)], [part("a", 0, 4), part("b", 5, 10)], [part("a", 0, 4), part("b", 3, 10)], [part("a", 0, 10), part("b", 10, 9)], [part("a", 0, -1)], [part("a", 0, 4), part("b", 5, 3), {}])],
    "not whole": [{**row(5), "parts": [part("a", 0, 9)]}, {**row(5), "parts": [part("a", 0, 11)]}, {**row(5, "😀"), "parts": [part("a", 0, 1)]}],
    "shelf": [{**row(5), "shelf": x} for x in ("attic", 5, None)], "shelved without a reason": [{**row(5), "shelf": "furniture"}, {**row(5), "shelf": "suppressed-head", "why": ""}], "image": [{**row(5), "image": 5}, {**row(5), "image": None}],
}


def test_one_bad_line_refuses_its_file(spark, tmp_path):
    files, want = {}, {}
    for why, heads in BAD_HEADS.items():
        for k, head in enumerate(heads):
            if head == "":
                continue
            files[f"h-{why}-{k}"] = [head, row(1)]
            want[f"h-{why}-{k}"] = (0, why)
    for why, bad in BAD_ROWS.items():
        for k, one in enumerate(bad):
            files[f"r-{why}-{k}"] = [HEAD, row(1), row(2), one, row(3)]
            want[f"r-{why}-{k}"] = (3, why)
    files["sound"] = [HEAD, row(1)]
    # the first fault in the order of lines tells, and on a line the first in the order of checks
    files["first"], want["first"] = [HEAD, row(1), {**row(2), "text": 1}, row(1), {**row(9), "id": "?"}], (2, "text or category")
    files["twice"], want["twice"] = [HEAD, row(1), row(1), {**row(1), "text": 1}], (2, "repeated id")
    files["both"], want["both"] = [HEAD, row(1), {**row(1), "text": 1}], (2, "repeated id")
    files["head"], want["head"] = [{**HEAD, "seams": 1, "loose": 1}, {**row(2), "text": 1}], (0, "seams")
    rows, heads, refused = read(spark, tmp_path / "x", {k.replace(" ", "_"): v for k, v in files.items()})
    assert {k: (seq, why) for k, (seq, _, why) in refused.items()} == {k.replace(" ", "_"): v for k, v in want.items()}
    assert set(rows) == {("sound", "b1-1")} and heads == {"sound"}


def test_files_without_lines_are_no_books(spark, tmp_path):
    _, heads, refused = read(spark, tmp_path / "x", {"none": [], "blank": ["", " ", "\t"], "sound": [HEAD]})
    assert heads == {"sound"} and refused == {}
    assert {r.book.rsplit("/", 1)[1] for r in book_files.empty_files(spark, str(tmp_path / "x")).collect()} == {"none", "blank"}


def test_written_books_come_back(spark, tmp_path):
    heads = spark.createDataFrame([(b, json.dumps(HEAD)) for b in ("x", "y")], "book string, value string")
    rows = spark.createDataFrame([(b, k, json.dumps(row(k, f"text {k}"))) for b in ("x", "y") for k in (3, 1, 2, 10)], "book string, pos long, value string")
    got, _, refused = book_files.book_files(spark, book_files.write_book_files(heads, rows.repartition(5), str(tmp_path / "w")))
    assert refused.count() == 0
    found = sorted((re.search("book=(.)", r.book)[1], r.seq, r.id) for r in got.collect())
    assert found == [(b, n + 1, f"b1-{k}") for b in ("x", "y") for n, k in enumerate((1, 2, 3, 10))]


@pytest.mark.parametrize("op", [{"op": "link", "block": "a", "note": "b", "at": -1, "len": 1}, {"op": "link", "block": "a", "note": "b", "at": 0, "len": 0}, {"op": "split", "id": "a", "at": 0}, {"op": "merge", "id": "a", "into": "a"}, {"op": "move", "id": "a", "before": "a"}, {"op": "strike", "id": ""}, {"op": "category", "id": "a", "category": ""}])
def test_ops_out_of_range_refuse_their_log(spark, tmp_path, op):
    good = [{"op": "link", "block": "a", "note": "b", "at": 0, "len": 1}, {"op": "split", "id": "a", "at": 1}, {"op": "move", "id": "a", "before": "b"}, {"op": "text", "id": "a", "text": ""}]
    (tmp_path / "ok").write_text("\n".join(map(json.dumps, good)))
    assert [r["into"] for r in banks.edit_log(spark, str(tmp_path / "ok")).orderBy("seq").collect()] == [None, None, "b", None]
    (tmp_path / "bad").write_text("\n".join(map(json.dumps, [*good, op])))
    with pytest.raises(Exception, match="bad op"):
        banks.edit_log(spark, str(tmp_path / "bad")).collect()


# --- re-binding -------------------------------------------------------------------------------------------------------

RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def folded_rebind(rows, refs, loose, orphans, edited, sources):
    """The same by walking rows, runs and lists. rows: id -> (pos, category, text); refs: note -> [(block, at, len)]."""
    heirs = {}
    for i in sorted(edited, key=lambda i: rows[i][0]):
        for src in sources.get(i, {i}):
            heirs.setdefault(src, []).append(i)
    found, free = {}, [x for x in loose if x[0] not in heirs]
    for i in edited:
        pos, category, text = rows[i]
        notes = [n for n in sorted(refs, key=lambda n: rows[n][0]) if any(i in heirs.get(block, ()) for block, _, _ in refs[n])]
        taken = set()
        for m in re.finditer(f"[{RAISED}]+", text) if category != "Footnote" else ():
            printed = int("".join(str(RAISED.index(c)) for c in m.group()))
            for n in notes:
                lead = re.match(r"([0-9]{1,3})[ \t]", rows[n][2])
                if n not in taken and lead and int(lead[1]) == printed:
                    taken.add(n)
                    found[n, i] = (i, m.start(), len(m.group()))
                    break
            else:
                free.append((i, m.start(), len(m.group()), printed))
    out, alone = {}, set(orphans)
    for n, was in refs.items():
        kept, done = [], set()
        for ref in was:
            if ref[0] not in heirs:
                kept.append(ref)
                continue
            for i in heirs[ref[0]]:
                if i not in done:
                    done.add(i)
                    kept += [found[n, i]] if (n, i) in found else []
        out[n] = kept
        if not kept:
            alone.add(n)
    return out, sorted(free), alone


def test_rebinding_equals_a_fold(spark):
    cases = []
    for seed in range(25):
        rng = random.Random(seed)
        n = rng.randint(4, 14)
        ids = [f"r{k}" for k in range(n)]
        rows = {}
        for k, i in enumerate(ids):
            note = rng.random() < 0.45
            body = "".join(rng.choice(["word ", RAISED[rng.randint(1, 3)], "²¹", " "]) for _ in range(rng.randint(0, 8)))
            rows[i] = (k, "Footnote" if note else "Text", f"{rng.randint(1, 3)}{rng.choice([' ', 'x'])}{body}" if note else body)
        refs = {i: [(rng.choice([*ids, "gone", "gone2"]), rng.randint(0, 5), 1) for _ in range(rng.randint(1, 5))] for i in ids if rows[i][1] == "Footnote"}
        edited = set(rng.sample(ids, rng.randint(0, n)))
        sources = {i: set(rng.sample([i, "gone", "gone2", rng.choice(ids)], rng.randint(1, 3))) for i in edited if rng.random() < 0.5}
        loose = [(rng.choice(ids), 0, 1, 5) for _ in range(2)]
        orphans = set(rng.sample(list(refs), min(len(refs), 1)))
        cases.append((f"b{seed}", rows, refs, loose, orphans, edited, sources))
    frame = lambda made, schema: spark.createDataFrame(made, schema)
    got = rebind.rebind(
        frame([(b, p, i, c, t) for b, rows, *_ in cases for i, (p, c, t) in rows.items()], "book string, pos int, id string, category string, text string"),
        frame([(b, n, k, *r) for b, _, refs, *_ in cases for n, was in refs.items() for k, r in enumerate(was)], "book string, note string, nth long, block string, at int, len int"),
        frame([(b, *x) for b, _, _, loose, *_ in cases for x in loose], "book string, block string, at int, len int, printed int"),
        frame([(b, x) for b, _, _, _, orphans, *_ in cases for x in orphans], "book string, note string"),
        frame([(b, i) for b, *_, edited, _ in cases for i in edited], "book string, id string"),
        frame([(b, i, s) for b, *_, sources in cases for i, some in sources.items() for s in some], "book string, id string, src string"),
    )
    refs = {}
    for r in got["refs"].orderBy("book", "note", "nth").collect():
        refs.setdefault((r.book, r.note), []).append((r.block, r.at, r.len))
    loose, orphans = {}, {}
    for r in got["loose"].collect():
        loose.setdefault(r.book, []).append((r.block, r.at, r.len, r.printed))
    for r in got["orphans"].collect():
        orphans.setdefault(r.book, set()).add(r.note)
    for b, *case in cases:
        want_refs, want_loose, want_orphans = folded_rebind(*case)
        assert {n: refs.get((b, n), []) for n in case[1]} == want_refs
        assert sorted(loose.get(b, [])) == want_loose and orphans.get(b, set()) == want_orphans


def test_lines_are_judged_once(spark, tmp_path):
    head = '{"book":3,"engine":"e","language":"en","source":{"pages":1,"unreadable":[],"bankSha":"s"},"chapters":[],"typography":null,"seams":[],"loose":{"markers":[],"notes":[]}}'
    row = '{"id":"b1-%s","category":"Text","text":"a😀é","page":1,"pages":[1],"box":null,"parts":[{"src":"1:0","page":1,"chars":[0,%s]}]}'
    (tmp_path / "good").write_text("\n".join([head, row % (1, 4), row % (2, 4)]))
    (tmp_path / "bad").write_text("\n".join([head, row % (1, 4), row % (1, 4), row % (2, 3)]))
    rows, _, refused = book_files.book_files(spark, str(tmp_path))
    assert [(r["id"], r["parts"][0]["end"]) for r in rows.orderBy("seq").collect()] == [("b1-1", 3), ("b1-2", 3)]
    assert [(r["seq"], r["why"]) for r in refused.collect()] == [(2, "repeated id")]
    assert "FileScan text" not in refused._jdf.queryExecution().sparkPlan().toString()
