"""Rules of pages, headings, flow and answers on single cases; ordered folds against plain Python; streams and banks."""

import collections
import html.parser
import json
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import blocks as B
from quire.operators import batches, chapters, explode, flow, ledger, markup, notes, prose, refs, replay, rows, running, splice, translate
from quire.sources import banks, books
from quire.streaming import intake

BLOCK = "book string, page int, ord int, category string, text string, x1 double, y1 double, x2 double, y2 double, page_width double, page_height double"


def block(page, ord, category, text, x1=300.0, y1=100.0, x2=700.0, y2=130.0):
    return "b", page, ord, category, text, float(x1), float(y1), float(x2), float(y2), 1000.0, 1400.0


def values(spark, columns):
    """The values of some Columns over one row."""
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def parsed(spark, answer):
    made = spark.createDataFrame([("b", 3, answer if isinstance(answer, str) or answer is None else json.dumps(answer))], "book string, page int, answer string")
    return [(r.category, r.text, r.bad) for r in B.parse_answers(made).collect()]


def refusal(spark, answer):
    made = spark.createDataFrame([("b", 3, answer if isinstance(answer, str) or answer is None else json.dumps(answer))], "book string, page int, answer string")
    (why,) = {r.why for r in B.all_elements(made).collect()}
    return why


def test_answers(spark):
    text = {"bbox": [1, 2, 3, 4], "category": "Text", "text": " Fine. "}
    fine = [("Text", "Fine.", False)]
    assert parsed(spark, [{"bbox": [1, 2, 3, 4], "category": "Picture"}, {"bbox": [1, 2, 3, 4], "category": "Text", "text": "  "}, text]) == [("Picture", "", False), *fine]
    for fence in ("```json\n%s\n```", "``` %s", "%s\n```\n", "\u00a0```JSON%s", "\n%s\t"):
        assert parsed(spark, fence % json.dumps([text])) == fine
    for other in (12, True, None, ["x"], {"x": "y"}):  # a text of another type is none
        assert parsed(spark, [{**text, "text": other}, text]) == fine
    assert parsed(spark, []) == [] and refusal(spark, []) is None
    assert parsed(spark, [{**text, "bbox": [1.5, -2, 3e2, 0]}]) == fine


def test_answers_are_refused_as_a_whole(spark):
    text = {"bbox": [1, 2, 3, 4], "category": "Text", "text": "x"}
    for answer in (text, "12", '"words"', "null", "no JSON at all", "[1", json.dumps([text]) + " and more", "[],[]", "[]}", '[],"z":2', "[NaN]"):
        assert refusal(spark, answer) == "no array", answer
    assert [refusal(spark, x) for x in ("", None, "```json\n```", " \n")] == ["empty"] * 4
    for element in (None, 7, "x", [1, 2, 3, 4]):
        assert refusal(spark, [text, element]) == "no element"
    for category in ("Marginalia", "text", None, 5, ["Text"], ""):
        assert refusal(spark, [text, {**text, "category": category}]) == "category"
    for box in ([0, 0, 1], [0, 0, 1, 1, 1], ["1", 0, 1, 1], [None, 0, 1, 1], None, "1,2,3,4", {"x": 1}, [True, 0, 1, 1]):
        assert refusal(spark, [text, {**text, "bbox": box}]) == "box"
    assert refusal(spark, '[{"bbox":[1,2,3,1e999],"category":"Text","text":"x"}]') == "box"
    assert refusal(spark, [{**text, "bbox": []}, {**text, "category": "?"}]) == "box"  # the first bad element tells
    assert all(bad for _, _, bad in parsed(spark, [text, {**text, "category": "Marginalia"}])) and len(parsed(spark, [text, {**text, "bbox": 1}])) == 2


def test_pages_are_read_whole(spark):
    element = lambda category, text, y: {"bbox": [10, y, 50, y + 10], "category": category, "text": text}
    page = [element("Page-header", "# 7", 0), element("Text", "before\n\n## Head \n> one\n>two\n\nafter", 20), element("List-item", "# kept", 40), element("Text", "", 900), element("Picture", "", 60), element("Title", "plain", 80)]
    rows = [("b", 1, json.dumps(page), 1000, 2000), ("b", 2, json.dumps(page) + "x", 1000, 2000), ("b", 3, "[]", 1000, 2000)]
    blocks, furniture, pages = B.read_pages(spark.createDataFrame(rows, "book string, page int, answer string, width int, height int"), 500_000)
    got = [(r.ord, r.part, r.category, r.text) for r in blocks.orderBy("ord", "part").collect()]
    assert got == [(1, 0, "Text", "before\n"), (1, 1, "Section-header", "Head"), (1, 2, "Quote", "one\ntwo"), (1, 3, "Text", "\nafter"), (2, 0, "List-item", "# kept"), (4, 0, "Picture", ""), (5, 0, "Title", "plain")]
    assert [(r.category, r.text) for r in furniture.collect()] == [("Page-header", "# 7")]
    assert [(r.page, r.why, r.raw_x, r.raw_y) for r in pages.orderBy("page").collect()] == [(1, None, 50.0, 910.0), (2, "no array", None, None), (3, None, 0.0, 0.0)]
    scale = values(spark, [G.render_scale(F.lit(2000.0), F.lit(1000.0), 500_000)])[0]
    assert scale > 1.9 and {round(r.x1 / scale, 6) for r in blocks.collect()} == {10.0}


def test_seams_are_sewn_where_they_are(spark):
    from quire.operators import sweep

    cut = lambda text, pattern=r"\([^()]*\)": sweep.cut(spark.createDataFrame([(text,)], "text string"), pattern).first()
    for text, want in (
        ("two  blanks kept", "two  blanks kept"), (" no match stays ", " no match stays "), ("word (cut), next", "word, next"), ("word (cut) next  far", "word next  far"), ("word (cut)\nnext", "word\nnext"), ("word\n(cut) next", "word\nnext"),
        ("a (x)(y) b", "a b"), ("a (x) (y). b", "a. b"), ("a(x)(y) b", "a b"), ("(x) a", "a"), ("a (x)", "a"), ("(x)", ""), ("a \t(x)\t b", "a \t b"), ("(x)\u00a0", ""), ("a ((x)) b", "a () b"), ("a (x) ) b", "a ) b"), ("a (x) - b", "a - b"),
    ):
        assert cut(text).swept == want, text
    assert cut("(x)").struck and not cut(" ").struck and cut(None).swept is None
    chosen = spark.createDataFrame([(1, 2, 5), (1, 8, 11)], "id long, start long, end long")
    rows = spark.createDataFrame([(1, "a (x) b (y) c"), (2, "a (x) b"), (3, "")], "id long, text string")
    assert [(r.swept, r.struck) for r in sweep.cut_spans(rows, chosen.where("start = 8")).orderBy("id").collect()] == [("a (x) b c", False), ("a (x) b", False), ("", False)]
    long = "word (cut) " * 50_000
    assert cut(long).swept == "word " * 49_999 + "word"


def test_imported_references(spark):
    texts = {"1. Thomas": 1, "**2.** Bold": 2, " *3 x": 3, "04 old": 4, "⁵ raised": 5, "1234 long": 1234, "none": 6, "x 7": 7, "\u00a08": 8}
    rows = spark.createDataFrame([("b", f"r{n}", "Text", t) for t, n in texts.items()] + [("b", "note", "Footnote", "9 x")], "book string, id string, category string, text string")
    asked = [("b", k, f"r{n}", n) for k, n in enumerate(texts.values())] + [("b", 50, "note", None), ("b", 51, "gone", 1), ("b", 52, "r1", 99), ("b", -1, "r1", 98), ("b", 53, "r2", None)]
    refs_made = spark.createDataFrame(asked, "book string, seq int, row string, printed int")
    got = {(r.seq, r.row): r.state for r in refs.imported_refs(refs_made, rows).collect()}
    promoted = {"r1", "r2", "r3", "r1234", "r8"}
    assert {row: s for (k, row), s in got.items() if 0 <= k < 50} == {f"r{n}": "promoted" if f"r{n}" in promoted else "unresolved" for n in texts.values()}
    assert [got[x] for x in ((50, "note"), (51, "gone"), (52, "r1"), (-1, "r1"), (53, "r2"))] == ["note", "unresolved", "note", "unresolved", "note"]


def test_labels_are_promoted_in_the_order_of_divisions(spark):
    def fold(rows, divisions):
        rows, out = {p: [c, t] for p, c, t in rows}, set()
        name = lambda t: " ".join(t.replace("*", "").split()).lower()
        for _, start, title in sorted(divisions):
            for p in range(start, start + 4):
                if not name(title) or p not in rows or rows[p][0] not in ("Text", "Section-header"):
                    break
                printed = name(rows[p][1])
                if not printed or printed not in name(title) and name(title) not in printed:
                    break
                rows[p][0] = "Title"
                out.add(p)
        return out

    def run(rows, divisions):
        made = spark.createDataFrame([("b", *r) for r in rows], "book string, pos long, category string, text string")
        asked = spark.createDataFrame([("b", *r) for r in divisions], "book string, nth long, pos long, title string")
        return {r.pos for r in refs.promoted_labels(made, asked).collect()}

    rows = [(0, "Text", "Kill-ing: America!"), (1, "Title", "Killing America"), (2, "Text", "america"), (5, "Text", "1"), (6, "Section-header", "KILLING  *America*"), (7, "Text", "prose"), (8, "Text", "")]
    assert run(rows, [(0, 0, "Killing America"), (1, 1, "Killing America"), (2, 5, "Chapter 1: Killing America"), (3, 8, "x")]) == {5, 6}
    import random

    for seed in range(4):
        rng = random.Random(seed)
        some = ["a", "A b", "*a*  b c", "c", "d", ""]
        made = [(p, rng.choice(["Text", "Text", "Section-header", "Title", "Picture"]) if rng.random() < 0.3 else "Text", rng.choice(some[: 2 + seed])) for p in range(120) if p % 17 != 5]
        asked = [(n, p, rng.choice(["a b c", "b", " "])) for n, p in enumerate(rng.sample([p for p, *_ in made], 60))]
        assert run(made, asked) == fold(made, asked)


def test_stale_steps_are_no_standard(spark):
    steps = spark.createDataFrame([("p", 1, None, "import", 1, None), ("p", 2, 1, "read", 2, False), ("p", 3, 2, "read", 3, True), ("p", 4, 3, "translate", 4, True), ("p", 5, 1, "read", 9, None)], "project string, id long, parent long, action string, created long, stale boolean")
    at = spark.createDataFrame([("p", 4)], "project string, at long")
    got = ledger.current_standard(steps, ledger.ancestry(steps), at).collect()
    assert {(r.action, r.id) for r in got} == {("import", 1), ("read", 2)}


def test_sentences_go_on(spark):
    goes = lambda a, b: values(spark, [X.continues_textually(F.lit(a), F.lit(b))])[0]
    assert goes("The town was", "divided in two") and goes("ends in a sign `", "goes on") and goes("blank at its end \n", "goes on")
    assert not goes("It ended.", "then") and not goes("It ended. ", "then") and not goes("The town", "Was") and not goes("The town", " was") and not goes("", "was")


def test_broken_words(spark):
    words = spark.createDataFrame([("b", w) for w in ("lanterns", "well-tempered")], "book string, word string")
    made = spark.createDataFrame([("b", 1, k, t) for k, t in enumerate(("two Lan-\nterns and well-\ntempered", "orch-\nard", "Franco-\nDutch y", "nothing broken"))], "book string, page int, ord int, text string")
    got = {r.ord: r.text for r in flow.dehyphenated(made, words).collect()}
    assert got == {0: "two Lanterns and well-tempered", 1: "orchard", 2: "Franco-Dutch y", 3: "nothing broken"}


def starts(spark, made, extra=""):
    return [r.para for r in flow.paragraph_starts(spark.createDataFrame(made, "book string, page int, ord int, category string, text string, align string" + extra)).orderBy("page", "ord").collect()]


def test_paragraphs(spark):
    t = lambda page, ord, text, category="Text", align="": ("b", page, ord, category, text, align)
    assert starts(spark, [t(1, 0, "The land was"), t(2, 0, "divided.")]) == [1, 1]
    assert starts(spark, [t(1, 0, "The land was"), t(3, 0, "divided.")]) == [1, 2]
    assert starts(spark, [t(1, 0, "The land was"), t(1, 1, "note", "Footnote"), t(2, 0, "divided.")]) == [1, 1]
    assert starts(spark, [t(1, 0, "The land was"), t(1, 1, "a table", "Table"), t(2, 0, "divided.")]) == [1, 2, 3]
    assert starts(spark, [t(1, 0, "The land was"), t(2, 0, "divided.", align="center")]) == [1, 2]
    decided = [(*t(1, 0, "It ended."), None), (*t(2, 0, "Then more"), True), (*t(2, 1, "and more"), False)]
    assert starts(spark, decided, ", decision boolean") == [1, 1, 2]
    assert starts(spark, [(*t(1, 0, "The land was"), False), (*t(2, 0, "divided."), True)], ", starts boolean") == [1, 2]


def headings(spark, made):
    return [(r.page, r.ord, r.n, r.category, r.label) for r in flow.merged_headings(spark.createDataFrame(made, BLOCK)).orderBy("page", "ord").collect()]


def test_headings_merge(spark):
    number = block(5, 0, "Section-header", "II", 480, 300, 520, 380)
    title = lambda **x: block(5, 1, "Title", "What the judgment cost", **({"x1": 400, "y1": 420, "x2": 900, "y2": 500} | x))
    assert headings(spark, [number, title()]) == [(5, 0, 2, "Title", "II: What the judgment cost")]
    assert len(headings(spark, [number, block(5, 1, "Text", "prose between"), ("b", 5, 2, *title()[3:])])) == 2
    assert len(headings(spark, [number, ("b", 6, *title()[2:])])) == 2
    assert len(headings(spark, [number, title(x1=700.0, x2=1200.0)])) == 2  # another column
    assert len(headings(spark, [number, title(y1=780.0, y2=860.0)])) == 2  # lines of white between
    assert len(headings(spark, [block(5, 0, "Title", "one whole statement of many words", 400, 300, 900, 380), block(5, 1, "Title", "and another one as long as that", 400, 400, 900, 480)])) == 2
    # the gap is judged by the larger type of both
    assert len(headings(spark, [block(5, 0, "Title", "PART", 400, 300, 900, 400), block(5, 1, "Title", "small", 400, 540, 900, 560)])) == 1


def kinds(spark, made):
    return {r.page: r.kind for r in B.page_kinds(spark.createDataFrame(made, BLOCK)).collect()}


def test_pages(spark):
    prose = "word " * 30
    front = [block(k, 0, "Text", prose) for k in range(1, 7)]
    boiler = ["Copyright 1990 by someone", "isbn 3-16", "10 9 8 7 6 5 4 3"]
    made = [block(0, k, "Text", t) for k, t in enumerate(boiler)] + front + [block(9, 0, "Title", "PART two"), block(11, 0, "Text", prose)]
    got = kinds(spark, made)
    assert got[0] == "copyright" and got[9] == "part" and got[11] is None
    assert kinds(spark, [block(0, 0, "Text", "uncopyrighted first published by a printer"), *front])[0] is None
    assert kinds(spark, [block(0, 0, "Text", "copyright and ISBN"), block(0, 1, "Title", "A heading"), *front])[0] != "copyright"
    assert kinds(spark, [*made[:-1]])[9] is None  # nothing follows
    assert kinds(spark, [*front, block(8, 0, "Title", "PART time"), block(10, 0, "Text", prose)])[8] is None
    roman = [*front, block(0, 0, "Text", prose), block(8, 0, "Title", "IV"), block(8, 1, "Text", "The short name"), block(9, 0, "Text", prose)]
    assert kinds(spark, roman)[8] == "part" and kinds(spark, [r for r in roman if r[4] != "The short name"])[8] is None
    assert kinds(spark, [block(0, 0, "Title", "The Book"), block(0, 1, "Text", "by someone"), *front])[0] == "title-page"
    assert kinds(spark, [block(0, 0, "Title", "The Book", 100, 100, 300, 130), *front])[0] is None  # not centred
    contents = [block(20, 0, "Title", "Contents"), *[block(20, k, "Text", f"Chapter {'abc'[k - 1]}, {k}8") for k in (1, 2, 3)]]
    assert kinds(spark, [*front, *contents])[20] == "contents" and kinds(spark, [*front, *contents[:3]])[20] is None
    # page furniture is no part of a page
    assert kinds(spark, [block(0, 0, "Page-header", "Title page " * 9), block(0, 1, "Title", "The Book"), *front])[0] == "title-page"


def test_chapters(spark):
    heads = ["Chapter One", "Afterword", "IX.", "Chapitre 1", "indexes", "Foreword"]
    made = [block(k, 0, "Section-header", t, 100, 100, 300, 130) for k, t in enumerate(heads)]
    got = {r.label: r.why for r in B.chapter_proposals(spark.createDataFrame(made, BLOCK)).collect()}
    assert got == {x: "chapterish-text" for x in ("Chapter One", "Afterword", "IX.", "Foreword")}
    numbers = [block(k, 0, "Title", t) for k, t in enumerate(("1", "2", "1", "2", "Chapter 7"))]
    assert [r.label for r in B.chapter_proposals(spark.createDataFrame(numbers, BLOCK)).collect()] == ["Chapter 7"]
    rising = [block(k, 0, "Title", str(k)) for k in range(1, 5)]
    assert B.chapter_proposals(spark.createDataFrame(rising, BLOCK)).count() == 4
    spoken = spark.createDataFrame([("b", 1)], "book string, page int")
    assert B.chapter_proposals(spark.createDataFrame(rising, BLOCK), spoken).count() == 3
    low = [block(1, 0, "Page-header", "head"), block(1, 1, "Title", "Upper"), block(2, 0, "Title", "Lower", y1=900.0), block(3, 0, "Text", "x"), block(3, 1, "Title", "Second")]
    assert [r.label for r in B.chapter_proposals(spark.createDataFrame(low, BLOCK)).collect()] == ["Upper"]


def test_complaints(spark):
    say = lambda q, a: values(spark, [translate.complaint(F.lit(q), F.lit(a))])[0]
    source = "Ein langer Satz, der viele Wörter hat und noch weiter geht."
    assert say(source, "   ") == "empty" and say(source, "```\n\n```") == "empty" and say(source, "⟦m1⟧ ⟦m2⟧") == "only markers"
    assert say(source, "Short.") == "too short" and say("Ein Satz.", "A sentence. " * 12) == "too long" and say("⟦m1⟧", "abc") == "too long"
    assert say(source, source) is None and say(source, "```text\n" + source + "\n```") is None and say("Berlin", "Berlin") is None


@pytest.mark.parametrize(
    "markup_in, want",
    [
        ("<p>a<script>x<b></script>b</p>", "<p>ab</p>"), ("a</script>b<style>c", "abc"), ('<a onclick="x()" href="y">z</a>', '<a href="y">z</a>'), ("<a HREF=' javascript:x()'>z</a>", "<a>z</a>"),
        ('<svg xlink:href="javascript:1" data="javascript:2" formaction="ok">', '<svg formaction="ok">'), ("<iframe src=x></iframe >t<object><b>u</b></object>", "t"), ("<p title='<script>'>k</p>", "<p title='<script>'>k</p>"), ("<!-- <script> --><i>k</i>", "<!-- <script> --><i>k</i>"),
    ],
)
def test_unsafe_markup(markup_in, want):
    assert markup.safe_markup(markup_in) == want


def test_small_functions(spark):
    text = F.lit("﻿﻿x")
    got = values(spark, [X.strip_bom(text), X.strip_illegal_xml(F.lit("a\x01b￾c\n")), X.inline_markup(F.lit("**a** *b* <c>\nd")), X.superscript_number(F.lit("see¹²")), X.plain_word_count(F.lit(" a *  b ")), X.flatten_table(F.lit("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>")), X.printed_page(F.lit(" Page 12 ")), X.printed_page(F.lit("S. ix"))])
    assert got == ("﻿x", "abc\n", "<strong>a</strong> <em>b</em> &lt;c&gt;<br/>\nd", 12, 3, "a \n  b", "12", "ix")
    hrefs = [X.resolved_href(F.lit("OEBPS/text/a.xhtml"), F.lit(h)) for h in ("../img/b%20c.png#x", "./d.xhtml", "/e/../f", "#g", "a+b.xhtml", "../../../h")]
    assert values(spark, hrefs)[:3] == ("OEBPS/img/b c.png", "OEBPS/text/d.xhtml", "f") and values(spark, hrefs)[4:] == ("OEBPS/text/a+b.xhtml", "h")
    assert values(spark, [X.language_tag(F.lit(t)) for t in ("EN_us", "zh-hans-cn", "Deutsch", "x")]) == ("en-US", "zh-Hans-CN", None, None)
    runs = values(spark, [refs.superscript_runs(F.lit("a¹ b²³c"))])[0]
    assert [tuple(r) for r in runs] == [(1, 1, 1), (4, 2, 23)]
    assert values(spark, [X.match_spans(F.lit("none"), "[0-9]+")])[0] == []


def test_geometry(spark):
    point = lambda *p: F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in p])
    square = point((0, 0), (10, 0), (10, 20), (0, 20))
    turned, left, scale, box = values(spark, [G.turned(square, 1), G.halves(square, F.lit(0.5))[0], G.render_scale(F.lit(1000), F.lit(2000), 2_000_000), G.box_to_display(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0), F.lit(1000.0), F.lit(1000.0), F.lit(500.0), F.lit(700.0))])
    assert turned == [[0, 20], [0, 0], [10, 0], [10, 20]] and left == [[0, 0], [5, 0], [5, 20], [0, 20]]
    assert abs(scale - 2000 / 1988) < 0.01 and (box.x, box.y, box.w, box.h) == (0.0, 665.0, 50.0, 35.0)
    assert values(spark, [G.same_shape(square, point((0, 0), (20, 0), (20, 40), (0, 40))), G.same_shape(square, point((0, 0), (20, 0), (20, 20), (0, 20)))]) == (True, False)


def test_running_values_do_not_depend_on_the_step(spark):
    rng = random.Random(1)
    made = [(rng.choice("xyz"), k, rng.choice([None, rng.randint(0, 50)])) for k in rng.sample(range(2000), 300)] + [(None, 5, 1), (None, 900, 2)]
    df = spark.createDataFrame(made, "g string, o long, v int")
    for step in (7, 100, 10_000):
        sums = {(r.g, r.o): r.s for r in running.running(df, ["g"], "o", "v", F.sum, "s", step=step).collect()}
        tops = {(r.g, r.o): r.s for r in running.running(df, ["g"], "o", "v", F.max, "s", before=True, step=step).collect()}
        last = {(r.g, r.o): r.s for r in running.previous(df, ["g"], ["o"], "v", "s", step=step).collect()}
        then = {(r.g, r.o): r.s for r in running.following(df, ["g"], "o", "v", "s", step=step).collect()}
        for g, o, v in made:
            before = sorted((b, w) for h, b, w in made if h == g and b < o)
            after = [w for b, w in sorted((b, w) for h, b, w in made if h == g and b > o) if w is not None]
            known = [w for _, w in before if w is not None]
            upto = known + ([v] if v is not None else [])
            assert sums[g, o] == (sum(upto) if upto else None) and tops[g, o] == (max(known) if known else None)
            assert last[g, o] == (before[-1][1] if before else None) and then[g, o] == (after[0] if after else None)


def test_following_values_lie_behind_equal_orders(spark):
    made = [("x", 5, None, 1), ("x", 5, 7, 2), ("x", 5, 6, 3), ("x", 9, 4, 4), ("x", 9, 3, 5), ("y", 5, 1, 6), ("y", 5, None, 7)]
    for step in (1, 7, 100):
        for rows in (made, made[::-1]):
            df = spark.createDataFrame(rows, "g string, o long, v int, k int").coalesce(1)
            got = {r.k: r.s for r in running.following(df, ["g"], "o", "v", "s", step=step).collect()}
            assert got == {1: 3, 2: 3, 3: 3, 4: None, 5: None, 6: None, 7: None}


def test_batches_are_taken_in_short_runs():
    texts = ["x" * 90, None, "", "y" * 2000, "z"] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts), pa.array([None if t is None else [t, None] for t in texts])], names=["id", "text", "parts"])
    for by in (1, "parts"):
        got = list(batches.sliced([batch, batch.slice(0, 0), batch.slice(3, 5)], by, most=1000))
        assert [i for b in got for i in b.column(0).to_pylist()] == [*range(200), *range(3, 8)]
        assert max(sum(len(t or "") for t in b.column(1).to_pylist()) for b in got) <= 3000
    wide = pa.array([f"<b>{'<i>x</i>' * 30_000}</b>"] * 9)
    docs = pa.RecordBatch.from_arrays([pa.array(range(9)), wide], names=["doc", "markup"])
    for read in (markup._elements, splice._spans):
        assert max(b.num_rows for b in read([docs])) <= 5 * 30_001 and sum(b.num_rows for b in read([docs])) == 9 * 30_001


def test_a_circle_of_steps_is_refused(spark):
    steps = lambda made: spark.createDataFrame(made, "project int, id int, parent int")
    with pytest.raises(ValueError, match="own ancestor"):
        ledger.ancestry(steps([(1, 1, 3), (1, 2, 1), (1, 3, 2)]))
    chain = ledger.ancestry(steps([(1, k, k - 1 if k > 1 else None) for k in range(1, 30)]))
    assert chain.count() == 29 * 30 // 2 and chain.agg(F.max("depth")).first()[0] == 28


def test_pointer_of_a_deleted_subtree_goes_up(spark):
    steps = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (2, 1, None)], "project int, id int, parent int")
    pointers = spark.createDataFrame([(1, 3), (2, 1)], "project int, pointer int")
    removed = steps.where("project = 1 and id > 1").select("project", "id")
    got = ledger.moved_pointers(pointers, removed, removed.where("id = 2"), steps)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1)}


def brute_chapters(seed, log):
    now = list(seed)
    for op, i, into, title in log:
        at = next((k for k, (j, _) in enumerate(now) if j == i), None)
        if op == "chapter-reset":
            now = list(seed)
        elif op == "chapter-set":
            if at is None:
                now.append((i, title))
            else:
                now[at] = (i, title)
        elif op == "chapter-rename" and at is not None:
            now[at] = (i, title)
        elif op == "chapter-remove" and at is not None:
            del now[at]
        elif op == "chapter-move" and at is not None and all(j != into for j, _ in now):
            now[at] = (into, now[at][1])
    return set(now)


def test_chapter_verbs(spark):
    rng = random.Random(3)
    seeds = {b: [(f"r{k}", f"t{k}") for k in range(rng.randint(0, 4))] for b in "abcd"}
    logs = {b: [(rng.choice(chapters.VERBS[:4] * 4 + chapters.VERBS[4:]), f"r{rng.randint(0, 6)}", f"r{rng.randint(0, 6)}", f"new{k}") for k in range(rng.randint(0, 60))] for b in "abcde"}
    seed = spark.createDataFrame([(b, *x) for b, xs in seeds.items() for x in xs], "book string, id string, title string")
    ops = spark.createDataFrame([(b, k, *x) for b, xs in logs.items() for k, x in enumerate(xs)], "book string, seq int, op string, id string, into string, title string")
    got = collections.defaultdict(set)
    for r in chapters.replayed_chapters(seed, ops.repartition(3)).collect():
        got[r.book].add((r.id, r.title))
    assert all(got[b] == brute_chapters(seeds.get(b, []), logs[b]) for b in logs)


def test_links(spark):
    table = spark.createDataFrame([("b", "p", "0123456789", "Text", None), ("b", "n", "note", "Footnote", None), ("b", "s", "shelved", "Text", "head")], "book string, id string, text string, category string, shelf string")
    held = spark.createDataFrame([("b", "p", 0, 2)], "book string, block string, at int, len int")
    asked = [("p", 1, 2, "n", "claimed"), ("p", 2, 2, "n", None), ("p", 3, 2, "n", "claimed"), ("p", 4, 2, "n", None), ("p", 9, 2, "n", "past the end"), ("p", 6, 1, "p", "not a note"), ("s", 0, 1, "n", "no such row"), ("x", 0, 1, "n", "no such row"), ("p", 6, 1, "y", "no such note")]
    ops = spark.createDataFrame([("b", k, *a[:4]) for k, a in enumerate(asked)], "book string, seq int, block string, at int, len int, note string")
    assert [r.refused for r in chapters.linked(held, table, ops).orderBy("seq").collect()] == [a[4] for a in asked]


def test_structural_edits(spark):
    rng = random.Random(5)
    made = [("b", k, f"r{k}", f"text number {k}", "Footnote" if k % 9 == 4 else "Text") for k in range(25)]
    log = [("b", k, rng.choice(["strike", "restore", "text", "category", "merge", "split", "move"]), f"r{rng.randint(0, 27)}", f"said {k}", f"c{k % 3}", f"r{rng.randint(0, 27)}", rng.randint(0, 14)) for k in range(120)]
    got = replay.replay_structural(spark.createDataFrame(made, "book string, pos int, id string, text string, category string"), spark.createDataFrame(log, "book string, seq int, op string, id string, text string, category string, into string, at int"))
    now = [[i, t, c, False] for _, _, i, t, c in made]
    find = lambda i: next((r for r in now if r[0] == i), None)
    for _, _, op, i, said, kind, into, at in log:
        row, other = find(i), find(into)
        if row is None:
            continue
        if op in ("strike", "restore"):
            row[3] = op == "strike"
        elif op == "text":
            row[1] = said
        elif op == "category":
            row[2] = kind
        elif op == "merge" and other is not None and other is not row and "Footnote" not in (row[2], other[2]):
            other[1] += " " + row[1]
            now.remove(row)
        elif op == "split" and row[2] != "Footnote" and 0 < at < len(row[1]) and find(i + "/1") is None:
            k = now.index(row)
            now[k : k + 1] = [[i + "/1", row[1][:at], row[2], False], [i + "/2", row[1][at:], row[2], False]]
        elif op == "move" and other is not None and other is not row:
            now.remove(row)
            now.insert(now.index(other), row)
    assert [(r.id, r.text, r.category) for r in got.orderBy("pos").collect()] == [tuple(r[:3]) for r in now]


def test_elements_equal_the_standard_parser(spark):
    pages = ["<div id=a><p class='x'>one <b>two</b></p><ul><li>x</li><li>y</li></ul></div>", "<p>a<br>b<img src=c></p>", "plain", "<h1>T</h1><table><tr><td>1</td></tr></table>"]

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.stack = [], []

        def handle_starttag(self, tag, attrs):
            self.out.append((tag, self.stack[-1] if self.stack else None, dict(attrs)))
            if tag not in markup.VOID:
                self.stack.append(len(self.out) - 1)

        def handle_endtag(self, tag):
            self.stack.pop()

    got = markup.elements(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html").orderBy("doc", "id").collect()
    want = []
    for k, page in enumerate(pages):
        reader = Reader()
        reader.feed(page)
        want += [(k, *e) for e in reader.out]
    assert [(r.doc, r.tag, r.parent, r.attrs) for r in got] == want
    assert all(pages[r.doc][r.start : r.start + 1 + len(r.tag)] == f"<{r.tag}" for r in got)


def test_amended_blocks(spark):
    made = spark.createDataFrame([("b", k, "Text", f"t{k}") for k in range(4)], "book string, ord int, category string, text string")
    said = spark.createDataFrame([("b", 0, 1, True, None, None), ("b", 0, 2, False, None, "new"), ("b", 1, 3, True, None, None), ("b", 2, 4, None, "Title", None)], "book string, ord int, seq int, strike boolean, category string, text string")
    got = {(r.ord, r.category, r.text) for r in replay.amended(made, said, ["book", "ord"]).collect()}
    assert got == {(0, "Text", "new"), (2, "Title", "t2"), (3, "Text", "t3")}


def test_materialized_offsets(spark):
    cuts = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(n).alias("len")) for a, n in ((2, 2), (6, 1))])
    got = values(spark, [rows.cut_text(F.lit("ab12cd3ef"), cuts), *[rows.mapped_offset(F.lit(k), cuts) for k in (0, 2, 3, 4, 6, 7, 9)]])
    assert got == ("abcdef", 0, 2, 2, 2, 4, 4, 6)
    none = F.expr("cast(array() as array<struct<at:int,len:int>>)")
    assert values(spark, [rows.cut_text(F.lit("same"), none)])[0] == "same"


def test_banks(spark, tmp_path):
    good = [{"page": 1, "text": "a"}, {"page": 2, "text": "b", "tokens": 5, "finishReason": "stop", "render": {"width": 10, "height": 20}, "maxPixels": 7}, {"page": 1, "text": "c"}]
    (tmp_path / "one.jsonl").write_text("﻿" + "\n".join(map(json.dumps, good)) + '\n\n{"page": 3, "te')
    got = {r.page: (r.text, r.tokens, r.geometry is not None) for r in banks.readings(spark, str(tmp_path)).collect()}
    assert got == {1: ("c", 0, False), 2: ("b", 5, True)}
    (tmp_path / "two.jsonl").write_text('{"page": 3, "te\n' + json.dumps(good[0]) + "\n")
    with pytest.raises(Exception, match="bad line"):
        banks.readings(spark, str(tmp_path)).collect()


def test_edit_logs_are_checked(spark, tmp_path):
    ok = spark.createDataFrame([("b", 1, "strike", "r1", None), ("b", 2, "merge", "r1", "r2")], "book string, seq int, op string, id string, into string")
    back = banks.edit_log(spark, banks.write_lines(ok, f"file://{tmp_path}/ok")).orderBy("seq").collect()
    assert [(r.op, r.id, r.into) for r in back] == [("strike", "r1", None), ("merge", "r1", "r2")]
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "x.txt").write_text('{"op": "strike", "id": "r1"}\n{"op": "str')
    with pytest.raises(Exception, match="bad line"):
        banks.edit_log(spark, f"file://{tmp_path}/torn").collect()
    for op, into in (("merge", None), ("paint", "r2")):
        bad = spark.createDataFrame([("b", 1, op, "r1", into)], "book string, seq int, op string, id string, into string")
        with pytest.raises(Exception, match="bad op"):
            banks.edit_log(spark, banks.write_lines(bad, f"file://{tmp_path}/{op}")).collect()


def test_skip_lists(spark):
    assert sorted(r.page for r in banks.skip_list(spark, "3, 17,19-21").collect()) == [3, 17, 19, 20, 21]
    for bad in ("", "3,,4", "5-3", "0", "1-200000", "a"):
        with pytest.raises(ValueError):
            banks.skip_list(spark, bad)


def test_book_rows_keep_their_order_in_files(spark, tmp_path):
    made = spark.createDataFrame([(f"b{k % 3}", k, f"t{k}") for k in range(300)], "book string, pos int, text string").repartition(7)
    banks.write_book_rows(made, f"file://{tmp_path}/rows")
    for b in range(3):
        (file,) = (tmp_path / "rows" / f"book=b{b}").glob("part-*")
        assert [json.loads(line)["pos"] for line in file.read_text().splitlines()] == list(range(b, 300, 3))


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/one.txt", "one")
        z.writestr("two.txt", "two" * 1000)
    got = {r.path: bytes(r.content) for r in banks.zip_members(spark, str(tmp_path)).collect()}
    assert got == {"x/one.txt": b"one", "two.txt": b"two" * 1000}


def test_blocks_dump(spark):
    made = spark.createDataFrame([("b", 1, 1, "second"), ("b", 1, 0, "first")], "book string, page int, ord int, text string")
    got = {r.page: (r.json and [x["text"] for x in json.loads(r.json)], r.unreadable) for r in books.blocks_dump(made, spark.createDataFrame([("b", 2)], "book string, page int")).collect()}
    assert got == {1: (["first", "second"], False), 2: ([], True)}


def test_streamed_answers(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    answer = lambda seq, page, tokens, text="x", why=None: json.dumps({"book": "b", "seq": seq, "page": page, "tokens": tokens, "finish_reason": why, "text": text})
    run = lambda: intake.upsert_pages(intake.answer_stream(spark, str(source)), f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    (source / "1.json").write_text(answer(1, 7, 100, "old") + "\n" + answer(2, 8, 900))
    run()
    (source / "2.json").write_text(answer(3, 7, 50, "new"))
    run()
    assert {(r.page, r.seq, r.text) for r in intake.latest(spark, f"{tmp_path}/out").collect()} == {(7, 3, "new"), (8, 2, "x")}


def test_streamed_caps_equal_the_batch_rule(spark, tmp_path):
    from quire.operators import cap

    source = tmp_path / "in"
    source.mkdir()
    made = [("b", k, k, 300 * k, "length" if k == 4 else None, "" if k == 5 else "x") for k in range(1, 9)]
    fields = "book seq page tokens finish_reason text".split()
    (source / "1.json").write_text("\n".join(json.dumps(dict(zip(fields, r))) for r in made))
    stream = intake.cap_stream(intake.answer_stream(spark, str(source)))
    stream.writeStream.format("memory").queryName("caps").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    want = cap.sent_caps(spark.createDataFrame(made, intake.ANSWER)).select("seq", "cap")
    assert sorted(map(tuple, spark.table("caps").select("seq", "cap").collect())) == sorted(map(tuple, want.collect()))


def test_windows_with_late_events(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda ts, v: json.dumps({"ts": ts, "event_type": "a", "value": v})
    (source / "1.json").write_text(line("2024-01-01T00:10:00", 1.0) + "\n" + line("2024-01-01T00:50:00", 2.0))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(source))
    go = lambda: intake.windowed_events(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    go()
    (source / "2.json").write_text(line("2024-01-01T05:00:00", 3.0))
    go()
    (source / "3.json").write_text(line("2024-01-01T00:20:00", 100.0))  # its window has been given
    go()
    (source / "4.json").write_text(line("2024-01-01T09:00:00", 4.0))
    go()
    got = {(r.start.hour, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (0, 2, 3.0) in got and not any(t >= 100 for _, _, t in got)


def test_markdown_pages(spark):
    page = "<header>head</header># One *two*\n\nfirst line\nsecond  \n- a\n  b\n- c\n1. d\ne\n\nplain\n---\n<table>\n<tr>\n\n</table>\n<img> a view </img> here\nafter"
    made = spark.createDataFrame([("b", 1, page), ("b", 2, "x\n<table>\n<tr>"), ("b", 3, "")], "book string, page int, text string")
    got = [(r.page, r.kind, r.level, r.ordered, r["items"], r.bad) for r in prose.markdown_blocks(made).orderBy("page", "seq").collect()]
    assert got[:-2] == [
        (1, "heading", 1, None, ["One *two*"], False), (1, "paragraph", None, None, ["first line second"], False), (1, "list", None, False, ["a b", "c"], False), (1, "list", None, True, ["d e"], False),
        (1, "paragraph", None, None, ["plain"], False), (1, "rule", None, None, [""], False), (1, "table", None, None, ["<table>\n<tr>\n\n</table>"], False), (1, "image", None, None, ["a view here"], False), (1, "paragraph", None, None, ["after"], False),
    ]
    assert [g[5] for g in got[-2:]] == [True, True]
    assert values(spark, [prose.inline_prose(F.lit("**a** *b* _c_ x*y*z <d> e²⁺"))]) == ("<strong>a</strong> <em>b</em> <em>c</em> x*y*z &lt;d&gt; e<sup>2+</sup>",)


def test_chapters_as_plain_text():
    chapter = "<section><h1>Head<br/>line</h1><p>One <em>two</em><sup>3</sup> &amp; <img src='x'/></p><blockquote><p>said</p><p>so</p></blockquote><ul><li>a</li><li> b </li></ul><table><thead><tr><th>x</th><th>y</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><hr/><h3>Small</h3></section>"
    assert prose.plain_chapter(chapter) == "Head\nline\n====\n\nOne two[3] & [figure]\n\n    said\n\n    so\n\na\nb\n\nx | y\n1 | 2\n\n* * *\n\nSmall"
    assert prose.plain_chapter("<p>a</p><video>x</video>") is None and prose.plain_chapter("") == ""


def test_imported_books(spark, tmp_path):
    import zipfile

    one = "<html><head><title>t</title></head><body><h1 id='c1'>One</h1><p>See<a href='two.xhtml#n1'><sup>1</sup></a> this.<br/>Next</p><blockquote><p>quoted</p></blockquote><ul><li>a</li><li><p>b</p></li></ul>loose <i>text</i><figure><img src='p.png' alt='A  view'/><figcaption>cap</figcaption></figure><table id='t'><tr><td onclick='x()'>1</td></tr></table><p class='h2'>Sub</p></body></html>"
    two = "<html><body><aside epub:type='footnote' id='n1'><p>1 The note.</p><p>More.</p></aside></body></html>"
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<container xmlns='urn:x'><rootfiles><rootfile full-path='OEBPS/p.opf'/></rootfiles></container>")
        z.writestr("OEBPS/p.opf", "<package xmlns='urn:y'><manifest><item id='b' href='two.xhtml'/><item id='a' href='text/one%20x.xhtml'/></manifest><spine><itemref idref='a'/><itemref idref='b'/></spine></package>")
        z.writestr("OEBPS/text/one x.xhtml", one)
        z.writestr("OEBPS/two.xhtml", two)
    documents = explode.epub_documents(spark, str(tmp_path))
    assert [(r.n, r.document) for r in documents.orderBy("n").collect()] == [(0, "OEBPS/text/one x.xhtml"), (1, "OEBPS/two.xhtml")]
    got = [(r.doc, r.category, r.text, list(r.anchors), [tuple(x) for x in r.refs]) for r in explode.exploded_rows(documents, "n", "markup").orderBy("doc", "n").collect()]
    assert got == [
        (0, "Title", "One", ["c1"], []), (0, "Text", "See¹ this.\nNext", [], [("two.xhtml#n1", 3, 1)]), (0, "Quote", "quoted", [], []), (0, "List-item", "a", [], []), (0, "List-item", "b", [], []), (0, "Text", "loose text", [], []),
        (0, "Picture", "A view", [], [("p.png", 0, 0)]), (0, "Caption", "cap", [], []), (0, "Table", "<table id='t'><tr><td>1</td></tr></table>", ["t"], []), (0, "Section-header", "Sub", [], []), (1, "Footnote", "1 The note.More.", ["n1"], []),
    ]


def test_a_book_as_it_reads(spark):
    body = lambda page, ord, text: block(page, ord, "Text", text, 100, 300, 900, 340)
    made = []
    for page in range(1, 5):
        made += [block(page, 0, "Page-header", "THE BOOK", y1=10.0, y2=30.0), block(page, 9, "Footnote", f"{page} note\n{page + 1} more")]
    made += [block(1, 1, "Title", "II", 480, 100, 520, 180), block(1, 2, "Title", "The Price", 400, 200, 900, 280), body(1, 3, "It was a gov-\nernment of the Anglo-"), body(2, 3, "saxon kind " + "word " * 30), body(3, 3, "Another begins")]
    made += [block(4, 2, "Section-header", "THE BOOK", y1=10.0, y2=30.0)]
    got = flow.reflowed_book(spark.createDataFrame(made, BLOCK))
    texts = [r.text for r in got["paragraphs"].orderBy("para").collect()]
    assert texts == ["II\nThe Price", "It was a government of the Anglosaxon kind " + ("word " * 30), "Another begins"]
    assert [r.page for r in got["sections"].collect()] == [1] and got["shelf"].count() == 1 and got["notes"].count() == 8


def test_notes_read_each_line_once(spark):
    lines = ["head", "2 two", "x", "3 three", "9 tail", "⁷ seven", "8 eight", "⁹⁹⁹⁹⁹⁹⁹⁹⁹⁹⁹ far", "1 one", ""]
    got = notes.split_notes(spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "k int, text string"), ["k"])
    assert [tuple(r) for r in got.orderBy("k", "note").collect()] == [(1, 0, None, "head\n2 two\nx\n3 three\n9 tail"), (1, 1, 7, "⁷ seven"), (1, 2, 8, "8 eight"), (1, 3, None, "⁹⁹⁹⁹⁹⁹⁹⁹⁹⁹⁹ far\n1 one\n"), (3, 0, None, "")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\A([⁰¹²³⁴⁵⁶⁷⁸⁹]+)") == 1


def _shuffled(spark, df):
    """Bytes that the jobs of a write of df shuffle."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    every = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, spark._sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    total = lambda: sum(every().apply(i).shuffleWriteBytes() for i in range(every().size()))
    before = total()
    df().write.format("noop").mode("overwrite").save()
    return total() - before


def test_paragraphs_look_up_broken_words_without_their_texts(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(20000)]
    lines = [(str(b), p, o, "Text", " ".join(r.choice(words) for _ in range(8)), "") for b in range(100) for p in range(4) for o in range(20)]
    made = lines + [("x", 0, 0, "Text", "the re-entry and re-", ""), ("x", 0, 1, "Text", "entry of cooper-", ""), ("x", 0, 2, "Text", "ation", "")]
    blocks = spark.createDataFrame(made, "book string, page int, ord int, category string, text string, align string").cache()
    blocks.count()
    got = flow.flow_paragraphs(blocks).where("book = 'x'").collect()
    assert [(r["n_blocks"], r["text"]) for r in got] == [(3, "the re-entry and re-entry of cooperation")]
    once = _shuffled(spark, lambda: blocks.repartition("book"))
    assert _shuffled(spark, lambda: flow.flow_paragraphs(blocks)) < 3 * once


def test_broken_words_are_healed_where_they_stand(spark):
    r = random.Random(7)
    halves = ["ab", "cd", "Ef", "éa", "Éb", "ñ", "×o", "g"]
    pairs = [(a, b) for a in halves for b in halves]
    known = {r.choice(pairs) for _ in range(30)}
    words = {("b", (a + ("-" if r.random() < 0.6 else "") + b).lower()) for a, b in known}
    made = []
    for k in range(300):
        text = "".join(r.choice(halves) + r.choice(["-\n", "-\n", " ", "-", "\n", ", "]) for _ in range(r.randint(1, 9)))
        made.append((r.choice("bc"), k % 7, k, text))

    def healed(book, text):
        def one(m):
            stem, word = m.group(1), m.group(2)
            fuse = (book, (stem + word).lower()) in words or ((book, f"{stem}-{word}".lower()) not in words and word[0] == word[0].lower())
            return stem + word if fuse else f"{stem}-{word}"

        return re.sub(flow.BROKEN, one, text)

    blocks = spark.createDataFrame([*made, ("b", 9, 999, None)], "book string, page int, ord int, text string")
    got = {x.ord: x.text for x in flow.dehyphenated(blocks, spark.createDataFrame(sorted(words), "book string, word string")).collect()}
    assert got == {k: healed(b, t) for b, _, k, t in made} | {999: None}


def test_broken_words_move_no_texts(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(6, 9))) for _ in range(20000)]
    lines = [(str(k % 50), k, 0, " ".join(w[:3] + "-\n" + w[3:] for w in (r.choice(words) for _ in range(8)))) for k in range(8000)]
    blocks = spark.createDataFrame([*lines, ("x", 0, 0, "coop-\neration co-\nop"), ("x", 0, 1, "cooperation co-op")], "book string, page int, ord int, text string").cache()
    blocks.count()
    lexicon = lambda: spark.createDataFrame([("x", "cooperation"), ("x", "co-op")], "book string, word string")
    got = flow.dehyphenated(blocks, lexicon()).where("book = 'x'").collect()
    assert sorted(x.text for x in got) == ["cooperation co-op", "cooperation co-op"]
    assert _shuffled(spark, lambda: flow.dehyphenated(blocks, lexicon())) < _shuffled(spark, lambda: blocks.repartition("book")) / 10


def test_facts_of_pages_are_made_once(spark):
    signs = ["\u00a9 2001", "COPYRIGHT by", "copyrights", "isbn 1", "All Rights Reserved", "LIBRARY of congress", "1 2 3 4 5", " 10 9 8 7", "12 a 345"]
    made = [block(k, 0, "Text", a + "\n" + b) for k, (a, b) in enumerate((a, b) for a in signs for b in signs)]
    kinds = B.page_kinds(spark.createDataFrame([(f"b{x[1] // 6}", *x[1:]) for x in made], BLOCK))
    assert "ISBN" not in kinds._jdf.queryExecution().executedPlan().toString()
    marks = lambda t: sum(bool(re.search(p, t, re.I | re.A)) for p in (r"©|\bcopyright\b", r"\bISBN\b", "all rights reserved", "library of congress")) + any(re.fullmatch("[0-9 ]+", s.strip()) and len(re.sub("[^0-9]", "", s)) >= 5 for s in t.split("\n"))
    assert {x.page: x.kind for x in kinds.collect()} == {x[1]: "copyright" if marks(x[4]) >= 2 else None for x in made}


def test_words_are_counted_between_blanks(spark):
    texts = ["", " ", "x", " x ", "*a* _b_", "__", "a\u00a0b c", "\n\x0ba\r\fb\t", "a*b_c", None]
    split = lambda t: len([w for w in re.split("[ \t\n\x0b\f\r]+", t) if w]) if t is not None else None
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.word_count(F.col("t")), X.plain_word_count(F.col("t"))).collect()
    assert [tuple(g) for g in sorted(got)] == [(k, split(t and t.replace("*", " ").replace("_", " ")), split(t)) for k, t in enumerate(texts)]


def test_a_book_is_written_once_and_dealt_out_once(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(20000)]
    made = [(f"b{k % 2}", k // 2, o, "Text", " ".join(r.choice(words) for _ in range(12)).capitalize() + ".", 100.0, 100.0 + 30 * o, 900.0, 112.0 + 30 * o, 1000.0, 1000.0) for k in range(1500) for o in range(20)]
    blocks = spark.createDataFrame(made, BLOCK).cache()
    blocks.count()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: sum(os.path.getsize(f"{at}/{f}") for at, _, names in os.walk(shared) for f in names)
    once, before = _shuffled(spark, lambda: blocks.repartition("book", "page")), held()
    assert _shuffled(spark, lambda: flow.reflowed_book(blocks)["paragraphs"]) < 1.5 * once
    assert held() - before < 1.5 * once


def test_paragraphs_equal_a_plain_fold(spark):
    r = random.Random(3)
    fields = "book string, page int, ord int, category string, text string, align string, decision boolean, starts boolean"
    some = ["goes on", "low re-", "Entry and", "entry.", "co-", "op", "Ends!", "", None, "é-", "éa x-"]
    made = []
    for b in ("a", "b", None):
        for page in sorted(r.sample([*range(40), *range(65_530, 65_545)], 40)):
            made += [(b, page, o, r.choice(["Text"] * 8 + ["Footnote", "Table", "Page-header"]), r.choice(some), r.choice(["", "", "", "right"]), r.choice([None] * 6 + [True, False]), r.choice([None] * 8 + [True])) for o in range(r.choice([1, 1, 2, 4]))]

    def joins(x, y):
        ok = lambda z: z[3] in flow.JOINABLE
        rule = y[5] == "" and y[1] - x[1] < 2 and bool(x[4]) and bool(y[4]) and not x[4].endswith(X.SENTENCE_ENDS) and y[4][0].upper() != y[4][0]
        return ok(x) and ok(y) and not y[7] and (rule if y[6] is None else y[6])

    def text(rows, known):
        out = rows[0][4]
        for x, y in zip(rows, rows[1:]):
            stem, word = re.search("([A-Za-zÀ-ÿ]+)-$", x[4] or ""), re.match("[A-Za-zÀ-ÿ]+", y[4] or "")
            if x[4] is None or out is None or y[4] is None:
                out = y[4] if x[4] is None else None
            elif stem and word:
                s, v = stem[1], word[0]
                fuse = (s + v).lower() in known or (f"{s}-{v}".lower() not in known and v[0] == v[0].lower())
                out = (out[:-1] if fuse else out) + y[4]
            else:
                out += " " + y[4]
        return out

    starts, paragraphs = {}, {}
    for b in ("a", "b", None):
        rows, paras = [x for x in made if x[0] == b and x[3] != "Footnote"], []
        for k, y in enumerate(rows):
            if k and joins(rows[k - 1], y):
                paras[-1].append(y)
            else:
                paras.append([y])
        starts |= {(b, y[1], y[2]): n for n, p in enumerate(paras, 1) for y in p}
        known = {w for x in made if x[0] == b for w in re.findall("[a-zà-ÿ]+(?:-[a-zà-ÿ]+)*", (x[4] or "").lower())}
        paragraphs |= {(b, n): (p[0][1], len(p), text(p, known)) for n, p in enumerate(paras, 1) if b}
    blocks = spark.createDataFrame(made, fields)
    assert max(n for _, n, _ in paragraphs.values()) > 3
    assert {(x.book, x.page, x.ord): x.para for x in flow.paragraph_starts(blocks).collect()} == starts
    assert {(x.book, x.para): (x.page, x.n_blocks, x.text) for x in flow.flow_paragraphs(blocks).collect() if x.book} == paragraphs
    opened = blocks.where("starts").select("book", "page", "ord").where("ord = 0")
    apart = blocks.withColumn("starts", F.when(F.col("ord") > 0, F.col("starts")))
    assert sorted(map(tuple, flow.flow_paragraphs(apart, opened).where("book is not null").drop("text").collect())) == sorted((b, n, p, k) for (b, n), (p, k, _) in paragraphs.items())
