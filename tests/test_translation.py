"""Tables on their grid, signs for markup and their checks, blocks to translate and documents rewritten, on single cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import grid, masks, sites

# --- tables -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "said, want",
    [(None, 1), ("", 1), ("two", 1), ("-3", 1), ("0", 1), ("2", 2), (" 7px", 7), ("1e9", 1), ("064", 64), ("65", 64), ("9" * 5000, 64), ("000", 1)],
)
def test_spans_are_whole_numbers_up_to_the_cap(said, want):
    assert grid.span(said) == want


def words(markup):
    return [[c[3] for c in row] for row in grid.rows_of(markup)]


def test_rows_and_cells_as_written():
    assert words("<table><tr><th>A</th><td> b &amp; <b>c</b> </td></tr><tr></tr><tfoot><tr><td>sum</td></tr></tfoot></table>") == [["A", "b & c"], ["sum"]]
    assert words("<tr><td>bare</td></tr>") == [["bare"]]
    assert words("<table><caption>title</caption><tr><td>a<td>b<tr><td>c</table> after <table><tr><td>second</td></tr></table>") == [["a", "b"], ["c"]]
    assert words("<table><tr><td>x<script>run()</script><style>p{}</style><template><b>t</b></template>y</td></tr></table>") == [["xy"]]
    assert words("<table><tr><td>out <table><tr><td>in</td></tr></table> side</td><td>z</td></tr></table>") == [["out in side", "z"]]
    assert words("no table here") == [] and words("") == [] and words("<table></table>") == []


def brute_placed(rows):
    """Every place of the grid by itself."""
    taken, columns = {}, []
    for y, row in enumerate(rows):
        x, mine = 0, []
        for _, across, down, _ in row:
            while taken.get((y, x)):
                x += 1
            mine.append(x)
            for dy in range(down):
                for dx in range(across):
                    taken[y + dy, x + dx] = taken.get((y + dy, x + dx), 0) + 1
            x += across
        columns.append(mine)
    inside = {k: n for k, n in taken.items() if k[0] < len(rows)}
    width = max((x for _, x in inside), default=-1) + 1
    return columns, width, bool(rows) and len(inside) == width * len(rows) and set(inside.values()) == {1}


def test_places_equal_a_grid_filled_place_by_place():
    rng = random.Random(5)
    whole = 0
    for _ in range(1500):
        rows = [[(False, rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3]), "") for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(0, 5))]
        got = grid.placed(rows)
        assert got == brute_placed(rows)
        whole += got[2]
    assert whole > 50


def test_tables_of_a_frame(spark):
    two = '<table><tr><th rowspan="2">r</th><th>a</th></tr><tr><td>b</td></tr></table>'
    long = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 20000 + "</table>"
    rows = [(1, two, "x"), (1, two, "x"), (2, None, "x"), (3, "", "x"), (4, "<tr><td colspan=2>a<tr><td>b", "x"), (5, long, "x")]
    df = spark.createDataFrame(rows, "doc long, markup string, grid string")
    got = {(r.doc, r.rows, r.columns, r.grid) for r in grid.tables(df).drop("cells").collect()}
    assert got == {(1, 2, 2, True), (2, 0, 0, False), (3, 0, 0, False), (4, 2, 2, False), (5, 20000, 2, True)}
    cells = grid.table_cells(grid.tables(df.limit(1)))
    assert sorted((r.row, r.k, r.col, r.text, r.head) for r in cells.collect()) == [(0, 0, 0, "r", True), (0, 1, 1, "a", True), (1, 0, 1, "b", False)]
    assert grid.tables(df.limit(0)).count() == 0


# --- signs ------------------------------------------------------------------------------------------------------------


def test_markup_becomes_signs_and_edges_go_aside():
    text, signs, leading, trailing, paired, single = masks.mask('<span id="p"/> Der <em class="x">v&ouml;lk<b>isch</b></em><br/> Staat<a href="#n"><sup>1</sup></a> &lt;x<!-- c --><br>')
    assert text == "Der ⟦e1⟧völk⟦e2⟧isch⟦/e2⟧⟦/e1⟧⟦m2⟧ Staat⟦m3⟧ <x"
    assert leading == '<span id="p"/> ' and trailing == "<!-- c --><br>" and (paired, single) == (2, 5)
    assert signs == [["e1", '<em class="x">', "</em>"], ["e2", "<b>", "</b>"], ["m2", "<br/>", None], ["m3", '<a href="#n"><sup>1</sup></a>', None]]


@pytest.mark.parametrize("inner, tag", [("a <p>b</p>", "p"), ("a</em>", "em"), ("<em>a", "em"), ("<em><b>a</em></b>", "em"), ("<a>x", "a")])
def test_markup_without_a_rule_is_refused(inner, tag):
    with pytest.raises(masks.Refused, match=f"^{tag}$"):
        masks.mask(inner)


def test_many_edges_and_signs_take_linear_time():
    text, signs, leading, trailing, _, single = masks.mask("<br> " * 20000 + "a <br> b" + " <br>" * 20000)
    assert text == "a ⟦m20001⟧ b" and len(signs) == 1 and single == 40001 and leading == "<br> " * 20000 and trailing == " <br>" * 20000


SENT = (["e1", "e2", "m1"], ["<em>", "<b>", "<br/>"], ["</em>", "</b>", None])
#: Answers to the signs e1, e2 (paired) and m1 (single), and what is wrong with each.
ANSWERS = [
    ("⟦e1⟧a ⟦e2⟧b⟦/e2⟧⟦/e1⟧ ⟦m1⟧", None),
    ("⟦m1⟧ ⟦e2⟧⟦/e2⟧ moved ⟦e1⟧x⟦/e1⟧", None),
    ("⟦e1⟧a⟦/e1⟧ ⟦e2⟧b⟦/e2⟧", ("missing", ["m1"])),
    ("", ("missing", ["e1", "e2", "m1"])),
    (None, ("missing", ["e1", "e2", "m1"])),
    ("⟦e1⟧a⟦/e1⟧ ⟦e2⟧b⟦/e2⟧ ⟦m1⟧⟦m1⟧", ("repeated", ["m1"])),
    ("⟦e1⟧a⟦/e1⟧⟦e1⟧a⟦/e1⟧ ⟦e2⟧b⟦/e2⟧ ⟦m1⟧", ("repeated", ["e1"])),
    ("⟦e1⟧a ⟦e2⟧b⟦/e1⟧⟦/e2⟧ ⟦m1⟧", ("crossed", ["e1", "e2"])),
    ("⟦e1⟧a⟦/e1⟧ b⟦/e2⟧ ⟦m1⟧", ("never opened", ["e2"])),
    ("⟦e1⟧a⟦/e1⟧ ⟦e2⟧b ⟦m1⟧", ("unclosed", ["e2"])),
    ("⟦e1⟧a⟦/e1⟧ ⟦e2⟧b⟦/e2⟧ ⟦m1⟧⟦/m1⟧", ("closed", ["m1"])),
    ("⟦e1 ⟧a⟦/e1⟧ ⟦E2⟧b⟦/e2⟧ ⟦m7⟧", ("invented", ["e1 ", "E2", "m7"])),
]


def test_each_complaint_and_what_comes_back(spark):
    df = spark.createDataFrame([(k, *SENT, a) for k, (a, _) in enumerate(ANSWERS)], "k int, ids array<string>, opens array<string>, shuts array<string>, answer string")
    singles = F.transform("shuts", lambda s: s.isNull())
    got = df.select("k", masks.complaint(F.col("ids"), singles, F.col("answer")).alias("c"), masks.restored(F.col("ids"), F.col("opens"), F.col("shuts"), F.col("answer")).alias("r")).orderBy("k").collect()
    assert [r.c and (r.c.reason, r.c.names) for r in got] == [w for _, w in ANSWERS]
    assert got[1].r == "<br/> <b></b> moved <em>x</em>" and got[11].r == "⟦e1 ⟧a</em> ⟦E2⟧b</b> " and got[3].r == ""


def plain_complaint(kinds, answer):
    """The same by a plain walk."""
    for body in re.findall("⟦([^⟦⟧]*)⟧", answer):
        if body.removeprefix("/") not in kinds:
            return "invented"
    stack, opened = [], []
    for shut, name in re.findall("⟦(/?)([em][0-9]+)⟧", answer):
        if not shut:
            opened.append(name)
            stack += [name] if kinds[name] else []
        elif not kinds[name]:
            return "closed"
        elif not stack:
            return "never opened"
        elif stack.pop() != name:
            return "crossed"
    if stack:
        return "unclosed"
    if set(kinds) - set(opened):
        return "missing"
    return "repeated" if len(set(opened)) < len(opened) else None


def test_random_answers_equal_a_plain_walk(spark):
    rng = random.Random(3)
    kinds = {"e1": True, "e2": True, "m1": False}
    some = ["⟦e1⟧", "⟦/e1⟧", "⟦e2⟧", "⟦/e2⟧", "⟦m1⟧"]
    answers = ["".join(rng.sample(some, 5)) for _ in range(300)] + ["w".join(rng.choices([*some, "⟦/m1⟧", "⟦e3⟧", "a & b"], weights=[9] * 5 + [1, 1, 9], k=rng.randint(0, 9))) for _ in range(700)]
    df = spark.createDataFrame([(k, *SENT, a) for k, a in enumerate(answers)], "k int, ids array<string>, opens array<string>, shuts array<string>, answer string")
    got = df.select("k", masks.complaint(F.col("ids"), F.transform("shuts", lambda s: s.isNull()), F.col("answer"))["reason"].alias("c")).orderBy("k").collect()
    want = [plain_complaint(kinds, a) for a in answers]
    assert [r.c for r in got] == want
    assert {None, "closed", "never opened", "crossed", "unclosed", "missing", "repeated", "invented"} == set(want)


# --- blocks -----------------------------------------------------------------------------------------------------------


def stamp(tag, category, inner, more=""):
    return f'<{tag} data-bf-cat="{category}"{more}>{inner}</{tag}>'


def page(body):
    return f"<html><body>{body}</body></html>"


def found(spark, *bodies, whole=()):
    docs = spark.createDataFrame([(k, page(b)) for k, b in enumerate(bodies)] + [(100 + k, w) for k, w in enumerate(whole)], "doc long, markup string")
    s, skipped, notes = sites.find_blocks(docs)
    text = dict(docs.collect())
    rows = sorted((r.doc, r.id, r.grp, r.kind, r.category, text[r.doc][r.inner_start : r.inner_end], r.row) for r in s.collect())
    order = {}
    for doc, _, grp, kind, category, inner, row in rows:
        order.setdefault((doc, grp), []).append((kind, category, inner, row))
    shown = [(d, ps[0][0], ps[0][1], [p[2] for p in ps]) for (d, _), ps in order.items()]
    sizes = [[sum(p[3] == r for p in ps) for r in sorted({p[3] for p in ps})] for ps in order.values() if ps[0][0] == "table"]
    return shown, sizes, sorted((r.doc, r.category, r.n) for r in skipped.collect()), sorted((r.doc, r.kind, r.why) for r in notes.collect())


def test_blocks_in_groups(spark):
    li = lambda t: stamp("li", "list-item", t)
    got, sizes, skipped, notes = found(
        spark,
        stamp("h1", "title", "T") + stamp("p", "text", " \n") + stamp("p", "text", "a <em>b</em>") + stamp("figure", "picture", stamp("figcaption", "caption", "c")),
        stamp("ul", "list-item", li("one") + "<hr/>" + li(" ") + li("two")) + stamp("blockquote", "quote", stamp("p", "text", "q")) + stamp("blockquote", "quote", "whole"),
        stamp("ul", "list-item", li("a" + stamp("ul", "list-item", li("b"))) + li("c")),
        stamp("div", "table", "<table><thead><tr><th>h</th><th></th></tr></thead><tr><td>1</td></tr><tr></tr></table>") + stamp("div", "text", stamp("table", "table", "<tr><td>in text</td></tr>")),
        stamp("div", "table", "<table><tr><td><table></table></td></tr></table>") + stamp("table", "table", "<tr><p>x</p></tr>") + stamp("table", "table", "") + stamp("p", "formula", "f"),
        stamp("div", "list-item", li("x") + li("y")) + stamp("div", "picture", stamp("p", "formula", "f")),
    )
    assert got == [
        (0, "single", "title", ["T"]), (0, "single", "text", ["a <em>b</em>"]), (0, "single", "caption", ["c"]),
        (1, "list", "list-item", ["one", "two"]), (1, "quote", "quote", ["q"]), (1, "single", "quote", ["whole"]),
        (2, "list", "list-item", ["b"]), (2, "single", "list-item", ["c"]),
        (3, "table", "table", ["h", "", "1"]),
        (5, "single", "list-item", ["x"]), (5, "single", "list-item", ["y"]),
    ]
    assert sizes == [[2, 1]]
    assert skipped == [(0, "picture", 1), (4, "formula", 1), (4, "table", 3), (5, "picture", 1)]
    assert notes == [(2, "list", "holds more than plain items")] + [(4, "table", "not a grid of cells")] * 3


def test_documents_without_a_rule_are_refused_alone(spark):
    odd = stamp("ul", "list-item", stamp("li", "sidebar", "taken"))
    got, _, skipped, notes = found(spark, stamp("p", "sidebar", "x") + stamp("p", "text", "y"), odd, whole=["<p data-bf-cat='text'>a</p>", "", None])
    assert got == [(1, "list", "list-item", ["taken"])] and skipped == []
    assert notes == [(0, "refused", "no rule for sidebar")] + [(k, "refused", "no html element") for k in (100, 101, 102)]


def test_documents_rewritten_with_their_answers(spark):
    li = lambda t: stamp("li", "list-item", t)
    body = stamp("p", "text", '<span id="p1"/>Ein <em>Wort</em> &amp; mehr', ' id="x"') + stamp("ul", "list-item", li("<b>a</b>") + li("b<i>c</i>")) + stamp("p", "text", "left <em>as</em> is") + stamp("p", "text", "no <p>rule")
    docs = spark.createDataFrame([(1, page(body), "t"), (2, page("plain"), "t"), (3, None, "t")], "doc long, markup string, text string")
    s, _, _ = sites.find_blocks(docs)
    masked = sites.masked_sites(docs, s)
    texts = {r.id: (r.text, r.refused) for r in masked.collect()}
    assert [texts[k][0] for k in sorted(texts)][:4] == ["Ein ⟦e1⟧Wort⟦/e1⟧ & mehr", "⟦e1⟧a⟦/e1⟧", "b⟦e2⟧c⟦/e2⟧", "left ⟦e1⟧as⟦/e1⟧ is"]
    answers = masked.select("doc", "id", F.when(F.col("text").startswith("left"), "lost").otherwise(F.replace(F.col("text"), F.lit("mehr"), F.lit("<more>"))).alias("answer"))
    written, complaints = sites.rewritten(docs, masked, answers)
    out = {r.doc: r.written for r in written.collect()}
    assert out == {1: page(body.replace("&amp; mehr", "&amp; &lt;more&gt;")), 2: page("plain"), 3: None}
    assert [(r.doc, r.reason, r.names) for r in complaints.collect()] == [(1, "missing", ["e1"])]


def test_text_that_an_answer_keeps_is_spelt_as_it_was(spark):
    p = lambda t: stamp("p", "text", t)
    docs = spark.createDataFrame([(1, page(p("and&amp") + p("a&am") + p("x &quot;y&quot; &am") + p("z&amp")))], "doc long, markup string")
    masked = sites.masked_sites(docs, sites.find_blocks(docs)[0])
    said = F.when(F.col("text").startswith("x"), F.concat("text", F.lit(" <b>"))).when(F.col("text").startswith("z"), F.concat("text", F.lit(";"))).otherwise(F.concat(F.lit("~& "), "text"))
    written, _ = sites.rewritten(docs, masked, masked.select("doc", "id", said.alias("answer")))
    assert written.first().written == page(p("~&amp; and&amp") + p("~&amp; a&am") + p("x &quot;y&quot; &am &lt;b&gt;") + p("z&amp;;"))


def test_languages_of_start_tags(spark):
    cases = [
        ('<html lang="de" xml:lang=\'de\'>', "en", '<html lang="en" xml:lang="en">'),
        ("<html>", 'e"&<$1', '<html xml:lang="e&quot;&amp;&lt;$1" lang="e&quot;&amp;&lt;$1">'),
        ('<html class="a" />', "fr", '<html class="a" xml:lang="fr" lang="fr"/>'),
    ]
    got = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, tag string, lang string, want string").select("k", "want", sites.retagged(F.col("tag"), F.col("lang")).alias("got")).collect()
    assert [(r.k, r.got) for r in got] == [(r.k, r.want) for r in got]
