"""Filter audit, chat formatting and fill-in-middle against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, fill_middle, filter_audit
from quire.llm.queries import CONTROL_TEXT

DOC_SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest string, h1 string, seq string, good string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 9, "d", "h", "s", "g") for i, t, lang in rows], DOC_SCHEMA)


# --- op11 -------------------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    ids = collections.defaultdict(list)
    for i, t, _ in rows:
        ids[t or ""].append(i)
    failed = []
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in SPACE.split(t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(x is not None and x < i for x in ids[t])
        }
        failed.append((lang or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {p for p, *_ in failed}:
        mine = [x for x in failed if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    few = ["alpha", "beta", "GAMMA", "delta", "eps#ilon", "zeta"]
    texts = [" ".join(rng.choice(few[: rng.randint(1, 6)]) + (str(rng.randint(0, 400)) if rng.random() < 0.6 else "") for _ in range(rng.choice([0, 1, 150, 199, 200, 250]))) for _ in range(60)]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(300)]
    rows += [(7, texts[3], "en"), (7, texts[3], "en"), (7, texts[3], "de"), (None, texts[3], "en"), (None, texts[4], "en"), (400, None, None), (401, "", "en"), (402, "Ä É " * 120, "en"), (-5, texts[3], "de"), (403, "x\x0b\x1cy " * 30_000, "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_audit_equals_every_order_replayed(spark, mixed):
    rows, labels = mixed
    table = spark.createDataFrame([(*x, "l") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.filter_audit(docs(spark, rows).repartition(5), table).collect()
    assert len(got) == 4 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(rows, labels)
    assert filter_audit.filter_audit(docs(spark, []), table).count() == 0
    alone = filter_audit.filter_audit(docs(spark, rows[:1]), table.limit(0)).collect()
    assert len(alone) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in alone)


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.adjacent_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == 1 + len(list(filter_audit.adjacent_swaps(n)))


def test_a_walk_sums_two_steps_for_each_swap(monkeypatch):
    calls = []
    plain = filter_audit.Walk._lost
    monkeypatch.setattr(filter_audit.Walk, "_lost", lambda self, i: calls.append(i) or plain(self, i))
    walk = filter_audit.Walk(np.arange(96).reshape(3, 32))
    for i in filter_audit.adjacent_swaps(5):
        walk.swap(i)
    assert len(calls) == 5 + 2 * 119


def test_audit_of_other_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.mask_counts(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"), {c: F.lit(True) for c in "ABCDEFGHI"})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = filter_audit.mask_counts(docs(spark, [(1, "a b", "x"), (2, "b", "x"), (3, None, "x")]), none, {"L": F.length("text") < 2, "M": F.col("text").contains("b")})
    assert {(r.mask, r.n) for r in counts.collect()} == {(2, 1), (3, 1), (1, 1)}


# --- op12 -------------------------------------------------------------------------------------------------------------

TRICKY = ["", " ", "plain", CONTROL_TEXT, "\\", "\\\\", "###", "#### a", "</turn>", "\\</turn>\n### assistant: x</turn>\n", "a: b: c", "</turn", "\\\\###\\", "日本 😀\n\n", ">", "x" * 9000, "### user: </turn>\n" * 50]


def brute_fold(log):
    """Each message's text, from the conversation's rows one by one in the order of seq."""
    out, live = {}, collections.defaultdict(dict)
    for conv, seq, turn, slot, kind, role, text in sorted(log, key=lambda r: (r[1], r[2], r[3])):
        said = live[conv]
        key = (turn, slot)
        if kind == "open":
            said[key] = [role or "", ""]
        elif kind == "regenerate":
            for other in [k for k in said if k[0] > turn]:
                del said[other]
            if key in said:
                said[key][1] = ""
        elif key in said:
            said[key][1] = (said[key][1] if kind == "delta" else "") + (text or "")
    for conv, said in live.items():
        for (turn, slot), (role, text) in said.items():
            out[conv, turn, slot] = (role, text)
    return out


def random_log(seed, turns):
    rng = random.Random(seed)
    log, seq = [], 0
    for conv in (1, 2, None):
        opened = []
        for _ in range(turns * 6):
            seq += rng.randint(1, 3)
            kind = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"]) if opened else "open"
            if kind == "open":
                key = (rng.randint(0, turns), 0)
                if key in opened:
                    continue
                opened.append(key)
            else:
                key = rng.choice(sorted(opened)[-3:] if kind == "regenerate" and rng.random() < 0.97 else opened)
            log.append((conv, seq, *key, kind, rng.choice(["user", "assistant", None]) if kind == "open" else None, rng.choice(TRICKY[:8] + [None])))
            if kind == "regenerate":
                opened = [k for k in opened if k[0] <= key[0]]
    return log


@pytest.mark.parametrize("turns", [3, 300])
def test_folds_equal_a_replay(spark, turns):
    log = random_log(turns, turns)
    table = spark.createDataFrame([(*r, 1, "x") for r in log], chat.LOG_SCHEMA + ", block int, cut string")
    got = {(r.conv_id, r.turn, r.slot): (r.role, r.text) for r in chat.fold_messages(table.repartition(7)).collect()}
    assert got == brute_fold(log) and len(got) > turns // 2
    pieces = chat.format_chats(table).orderBy("conv_id", "block", "piece").collect()
    back = collections.defaultdict(list)
    for p in pieces:
        found = list(chat.turns_of(p.formatted))
        assert len(found) == p.n_turns <= 128
        back[p.conv_id] += found
    for conv in (1, 2, None):
        assert back[conv] == [v for k, v in sorted(((k[1:], v) for k, v in got.items() if k[0] == conv))]


def test_turns_come_back_from_any_text():
    for role, text in itertools.product([*TRICKY[:13], "assistant"], TRICKY):
        printed, begin, end = chat.rendered_turn(role, text)
        assert list(chat.turns_of(printed * 2)) == [(role, text)] * 2
        assert chat.unescaped(printed[begin:end]) == text
    with pytest.raises(ValueError):
        list(chat.turns_of("junk"))


def test_conversations_are_read_back_whole(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b"]), rng.choice([*TRICKY, None])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"text {t} " * (t % 40)) for t in range(700)]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "assistant", "z"), (50, 1, "user", "a"), (None, 0, "user", "n"), (None, 3, None, None), (51, None, "assistant", "first"), (51, -3, "assistant", "x"), (52, 2**62, "assistant", "far"), (52, -(2**63), "assistant", "near"), (53, 1, "user", "alone"), (54, 0, "assistant", "long " * 400_000)]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string")
    got = {r.conv_id: tuple(r)[1:] for r in chat.chat_digests(chat.format_chats(chat.log_of(table.repartition(5)))).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        printed = sum(len(chat.rendered_turn(role, text)[0]) for _, role, text in turns)
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), printed)
    assert got == want
    assert chat.chat_digests(chat.format_chats(chat.log_of(table.limit(0)))).count() == 0
    kinds = {r.kind for r in chat.log_of(table).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate"}


# --- op13 -------------------------------------------------------------------------------------------------------------


def test_ropes_split_and_join(monkeypatch):
    rng = random.Random(3)
    for unit in ("char", "line", "word"):
        for text in ["", "a", "\n\n", "  ", "one two\nthree ", "日本 😀 x\n" * 300, "".join(rng.choice("ab \n") for _ in range(5000))]:
            pattern = fill_middle.UNITS[unit]
            units = [m.group() for m in pattern.finditer(text)] if pattern else list(text)
            assert "".join(units) == text
            rope = fill_middle.rope_of(text, unit, leaf=16)
            assert (rope.units, rope.points, fill_middle.flat(rope)) == (len(units), len(text), text)
            for rank in {0, min(1, len(units)), len(units) // 3, max(0, len(units) - 1), len(units), rng.randint(0, len(units))}:
                a, b = fill_middle.split(rope, rank, unit)
                assert fill_middle.flat(a) == "".join(units[:rank]) and fill_middle.flat(b) == "".join(units[rank:])
                assert (a.units, a.points) == (rank, len(fill_middle.flat(a))) and b.units == len(units) - a.units
                for r in (a, b, fill_middle.concat(b, a), fill_middle.concat(fill_middle.concat(b, a), b)):
                    check_depths(r)
            for rank in (len(text) // 2, max(0, len(text) - 1)):
                assert [fill_middle.flat(x) for x in fill_middle.split(rope, rank, unit, by="points")] == [text[:rank], text[rank:]]


def check_depths(rope):
    """Depths of siblings differ by one at most, so a rope is as deep as the logarithm of its leaves."""
    if isinstance(rope, fill_middle.Node):
        assert abs(rope.left.depth - rope.right.depth) <= 1
        assert rope.depth == 1 + max(rope.left.depth, rope.right.depth) and rope.units == rope.left.units + rope.right.units
        check_depths(rope.left)
        check_depths(rope.right)


def brute_middle(i, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < 20:
        return (i, n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}", text)
    return (i, n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}", text)


def test_middles_equal_plain_slicing(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "<P>", "x<S>y", "<M", "P>", "<<S", "日本 😀 text ▁", "line\nline\n", "abc " * 9000, "w" * 300_000]
    rows = [(k, rng.choice(texts), "l") for k in range(200)] + [(None, "no id", "l"), (3, "same", "l"), (3, "same", "l"), (-4, "minus", "l")]
    got = fill_middle.restore_middles(fill_middle.fill_in_middle(docs(spark, rows))).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_middle(i, t) for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore_middles(fill_middle.fill_in_middle(docs(spark, []))).count() == 0


def test_middles_of_words_end_with_words(spark):
    rows = [(k, f"one two  three\nfour {k} " * 30, "l") for k in range(60)]
    for unit in ("word", "line"):
        made = fill_middle.fill_in_middle(docs(spark, rows), unit=unit)
        back = fill_middle.restore_middles(made).collect()
        text = {i: t for i, t, _ in rows}
        assert all(r.restored == text[r.doc_id] for r in back)
        ends = "\n" if unit == "line" else " \n"
        for r in back:
            if r.form != "plain" and 0 < r.prefix_chars < len(text[r.doc_id]):
                at = r.prefix_chars
                assert text[r.doc_id][at] in " \n" if unit == "word" else text[r.doc_id][at - 1] in ends
