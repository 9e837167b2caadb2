"""Banks of many books: what a run does with each, and that a stop at any step leaves one whole bank and loses no page."""

import pytest

from quire.sources.shelf import Shelf

ASK = "book string, skip array<int>, language string, model string, fresh boolean, reuse boolean"


def ask(spark, *rows):
    return spark.createDataFrame([(b, o.get("skip"), o.get("language"), o.get("model"), o.get("fresh"), o.get("reuse")) for b, o in rows], ASK)


def said(spark, book, pages, word):
    return spark.createDataFrame([(book, p, k, f"{word} {p}") for k, p in enumerate(pages)], "book string, page int, seq long, text string")


def shown(opened):
    return {r.book: (r.action, r.target, r.carried, r.reason) for r in opened.collect()}


def bank(shelf):
    return sorted((r.book, r.page, r.text) for r in shelf.bank().collect())


def finished(spark, shelf, book="b", word="old", pages=(1, 2)):
    opened = shelf.open(ask(spark, (book, {"language": "en"})))
    shelf.append(opened, said(spark, book, pages, word))
    shelf.finish(opened, "2020")


@pytest.mark.parametrize("done", [0, 1, 2, 3])
def test_a_stop_after_each_step_leaves_one_whole_bank(spark, tmp_path, done):
    shelf = Shelf(spark, f"file://{tmp_path}/s")
    finished(spark, shelf)
    again = shelf.open(ask(spark, ("b", {"language": "en"})))
    assert shown(again) == {"b": ("read-fresh", "pending", 0, None)}
    shelf.append(again, said(spark, "b", (1, 2, 3), "new"))
    old, new = [("b", 1, "old 1"), ("b", 2, "old 2")], [("b", p, f"new {p}") for p in (1, 2, 3)]
    assert bank(shelf) == old
    for step in shelf.finish_steps(again, "2021")[:done]:
        step()
    assert bank(shelf) == (old if done < 2 else new)
    # the next run mends what was left without reading a page
    pages = spark.createDataFrame([("b", p) for p in (1, 2, 3)], "book string, page int")
    if done < 3:
        mend = shelf.open(ask(spark, ("b", {"language": "en"})))
        assert shown(mend) == {"b": ("resume", "pending" if done < 2 else "bank", 3, None)}
        assert shelf.missing(mend, pages).count() == 0
        shelf.finish(mend, "2021")
    assert bank(shelf) == new
    row = shelf.state().collect()[0]
    assert row.pending is None and (row.completed.completed_at, row.completed.pages) == ("2021", 3)
    assert shown(shelf.open(ask(spark, ("b", {"reuse": True})))) == {"b": ("reuse", None, 3, None)}


def test_what_a_run_does_with_each_book(spark, tmp_path):
    shelf = Shelf(spark, f"file://{tmp_path}/s")
    first = shelf.open(ask(spark, ("done", {}), ("part", {}), ("empty", {})))
    assert set(shown(first).values()) == {("read-fresh", "bank", 0, None)}
    shelf.append(first, said(spark, "done", (1, 2), "a").unionByName(said(spark, "part", (1,), "a")))
    shelf.finish(first.where("book = 'done'"), "2020")
    got = shown(shelf.open(ask(spark, ("done", {"reuse": True}), ("part", {"reuse": True}), ("empty", {"reuse": True}), ("new", {"fresh": True, "reuse": True}))))
    assert got == {"done": ("reuse", None, 2, None), "part": ("refused", None, 0, "no run has completed"), "empty": ("refused", None, 0, "nothing to reuse"), "new": ("refused", None, 0, "fresh and reuse")}
    second = shelf.open(ask(spark, ("done", {"skip": [3, 2, 3]}), ("part", {}), ("empty", {"fresh": True})))
    assert shown(second) == {"done": ("read-fresh", "pending", 0, None), "part": ("resume", "bank", 1, None), "empty": ("read-fresh", "bank", 0, None)}
    pages = spark.createDataFrame([(b, p) for b in ("done", "part", "empty") for p in (1, 2, 3)], "book string, page int")
    assert sorted(map(tuple, shelf.missing(second, pages).collect())) == [("done", 1), ("empty", 1), ("empty", 2), ("empty", 3), ("part", 2), ("part", 3)]
    shelf.append(second, said(spark, "done", (1,), "b"))
    # the same pages in any order are the same ask; another language is not, and fresh starts over
    assert shown(shelf.open(ask(spark, ("done", {"skip": [2, 3]})))) == {"done": ("resume", "pending", 1, None)}
    assert shown(shelf.open(ask(spark, ("done", {"skip": [2, 3], "language": "de"})))) == {"done": ("read-fresh", "pending", 0, None)}
    assert shown(shelf.open(ask(spark, ("part", {"fresh": True})))) == {"part": ("read-fresh", "pending", 0, None)}
    # a discarded version cannot be promoted any more
    with pytest.raises(Exception, match="nothing is pending for done"):
        shelf.finish(second.where("book = 'done'"), "2021")
    assert [t for b, _, t in bank(shelf) if b == "done"] == ["a 1", "a 2"]


def test_what_a_lost_job_left_is_not_seen(spark, tmp_path):
    shelf = Shelf(spark, f"file://{tmp_path}/s")
    finished(spark, shelf)
    before = bank(shelf)
    for folder in ("log/000000000099", "answers/000000000099-x"):
        (tmp_path / "s" / folder).mkdir(parents=True)
        (tmp_path / "s" / folder / "part-0.parquet").write_bytes(b"torn")
    assert bank(shelf) == before and shelf.state().count() == 1
    opened = shelf.open(ask(spark, ("b", {})))
    shelf.append(opened, said(spark, "b", (1, 1), "twice"))
    assert shown(opened) == {"b": ("read-fresh", "pending", 0, None)}
    shelf.finish(opened, "2021")
    assert bank(shelf) == [("b", 1, "twice 1")]


def test_asks_that_cannot_be_met_are_errors(spark, tmp_path):
    shelf = Shelf(spark, f"file://{tmp_path}/s")
    assert shelf.bank().count() == 0 and shelf.open(ask(spark, ("b", {})).limit(0)).count() == 0
    with pytest.raises(Exception, match="asked twice: b"):
        shelf.open(ask(spark, ("b", {}), ("b", {"language": "en"})))
    opened = shelf.open(ask(spark, ("b", {})))
    with pytest.raises(Exception, match="no bank was opened for c"):
        shelf.append(opened, said(spark, "c", (1,), "x"))
    assert shelf.bank().count() == 0
