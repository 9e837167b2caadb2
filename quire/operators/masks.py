"""Blocks without their markup: inline elements as numbered signs, answers checked against them, markup put back.

A paired sign stands for the tags of an element whose words belong to the sentence, a single one for a whole element. Masking
reads markup in a small walker; checks and restoring are folds and maps over one row's own answer, so nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .splice import TOKEN, VOID

#: Elements whose words belong to the sentence, and those that are kept whole.
PAIRED, SINGLE = frozenset("em strong i b cite q small u".split()), frozenset("a sup sub span br img code wbr".split())
#: A sign, and what looks like one.
SIGN, LIKE_SIGN = "⟦/?[em][0-9]+⟧", "⟦([^⟦⟧]*)⟧"
LEAD, TAIL = re.compile(r"(\s*)⟦(m[0-9]+)⟧(\s*)"), re.compile(r"(\s*)⟦(m[0-9]+)⟧(\s*)\Z")
PARTS = "array<struct<text: string, ids: array<string>, opens: array<string>, shuts: array<string>, leading: string, trailing: string, refused: string>>"


class Refused(Exception):
    """Markup without a rule; names its tag."""


def mask(inner: str, paired: int = 0, single: int = 0):
    """(text, signs as (id, open, close), leading, trailing, paired and single numbers used). close is None for a single sign.

    The text is decoded. Single signs at its edges go aside with the blanks beside them. An element without a rule, a closing
    tag without its start and an element that is not closed raise."""
    out: list[str] = []
    signs: list[list] = []
    stack: list[tuple[str, int]] = []
    whole: list[str] | None = None
    begun = at = 0

    def one(source: str) -> None:
        nonlocal single
        single += 1
        signs.append([f"m{single}", source, None])
        out.append(f"⟦m{single}⟧")

    for m in TOKEN.finditer(inner):
        if whole is None:
            out.append(entities.unescape(inner[at : m.start()]))
        at = m.end()
        tag = (m.group(5) or m.group(2) or "").lower()
        closed = m.group(4) if tag else None
        ends = bool(tag) and not closed and (tag in VOID or (m.group(6) or "").endswith("/"))
        if whole is not None:
            if tag and closed:
                if whole[-1] != tag:
                    raise Refused(tag)
                whole.pop()
                if not whole:
                    whole = None
                    one(inner[begun:at])
            elif tag and not ends and not m.group(2):
                whole.append(tag)
        elif not tag:
            one(m.group())
        elif closed:
            if not stack or stack[-1][0] != tag:
                raise Refused(tag)
            k = stack.pop()[1]
            signs[k][2] = m.group()
            out.append(f"⟦/{signs[k][0]}⟧")
        elif tag in PAIRED and not ends:
            paired += 1
            stack.append((tag, len(signs)))
            signs.append([f"e{paired}", m.group(), ""])
            out.append(f"⟦e{paired}⟧")
        elif tag in SINGLE or (tag in PAIRED and ends):
            if ends:
                one(m.group())
            else:
                whole, begun = [tag], m.start()
        else:
            raise Refused(tag)
    if stack or whole:
        raise Refused(stack[-1][0] if stack else whole[0])
    out.append(entities.unescape(inner[at:]))
    text, leading, trailing, gone = _edges("".join(out), {s[0]: s[1] for s in signs if s[2] is None})
    return text, [s for s in signs if s[0] not in gone], leading, trailing, paired, single


def _edges(text: str, sources: dict[str, str]) -> tuple[str, str, str, set[str]]:
    """The text without the single signs at its edges, what stood there, and the names of those signs."""
    start, end, leading, trailing, gone = 0, len(text), [], [], set()
    while (m := LEAD.match(text, start, end)) and m.group(2) in sources:
        leading.append(m.group(1) + sources[m.group(2)] + m.group(3))
        gone.add(m.group(2))
        start = m.end()
    while True:
        opens = text.rfind("⟦", start, end)
        back = opens
        while back > start and text[back - 1].isspace():
            back -= 1
        m = TAIL.match(text, back, end) if opens >= 0 else None
        if not m or m.group(2) not in sources:
            return text[start:end], "".join(leading), "".join(reversed(trailing)), gone
        trailing.append(m.group(1) + sources[m.group(2)] + m.group(3))
        gone.add(m.group(2))
        end = back


def _masked(batches):
    for rows in sliced(batches, "parts"):
        out = []
        for parts in rows.column("parts").to_pylist():
            paired = single = 0
            done = []
            for inner in parts or []:
                try:
                    text, signs, leading, trailing, paired, single = mask(inner or "", paired, single)
                    done.append({"text": text, "ids": [s[0] for s in signs], "opens": [s[1] for s in signs], "shuts": [s[2] for s in signs], "leading": leading, "trailing": trailing, "refused": None})
                except Refused as e:
                    done.append({"text": None, "ids": [], "opens": [], "shuts": [], "leading": "", "trailing": "", "refused": str(e)})
            out.append(done)
        strings = pa.list_(pa.string())
        kind = pa.list_(pa.struct([("text", pa.string()), ("ids", strings), ("opens", strings), ("shuts", strings), ("leading", pa.string()), ("trailing", pa.string()), ("refused", pa.string())]))
        yield rows.set_column(rows.schema.get_field_index("parts"), pa.field("parts", kind), pa.array(out, kind))


def masked_parts(groups: DataFrame, parts_col: str) -> DataFrame:
    """groups with ``parts`` for the column of parts: each part of a group masked, numbered through the group. A part that
    holds markup without a rule has no text and names the tag in ``refused``; null and empty parts have an empty text."""
    rows = groups.withColumnRenamed(parts_col, "parts")
    kinds = ", ".join(f"`{f.name}` {PARTS if f.name == 'parts' else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_masked, kinds)


def _name(sign: Column) -> Column:
    return F.regexp_replace(sign, "[⟦⟧/]", "")


def complaint(ids: Column, singles: Column, answer: Column) -> Column:
    """What is wrong with an answer's signs first, as struct(reason, names), or null.

    ids: the signs that were sent; singles: whether each is a single one. Reasons, in the order in which they are looked for:
    invented, closed though single, never opened, crossed (all three at the first place in the answer), unclosed, missing,
    repeated. Signs may be moved. A null answer counts as empty."""
    answer = F.coalesce(answer, F.lit(""))
    fault = lambda reason, names: F.struct(F.lit(reason).alias("reason"), names.alias("names"))
    none = F.lit(None).cast("struct<reason: string, names: array<string>>")
    shaped = F.regexp_extract_all(answer, F.lit(LIKE_SIGN), F.lit(1))
    bare = lambda s: F.regexp_replace(s, r"\A/", "")
    invented = F.filter(shaped, lambda s: ~(F.array_contains(ids, bare(s)) & bare(s).rlike(r"\A[em][0-9]+\z")))
    signs = F.regexp_extract_all(answer, F.lit(SIGN), F.lit(0))
    single = F.map_from_arrays(ids, singles)

    def step(acc, sign):
        name, shut, top = _name(sign), F.substring(sign, 2, 1) == "/", F.element_at(acc["stack"], -1)
        depth = F.size(acc["stack"])
        alone = single[name]
        found = (
            F.when(acc["fault"].isNotNull(), acc["fault"])
            .when(alone & shut, fault("closed", F.array(name)))
            .when(~alone & shut & (depth == 0), fault("never opened", F.array(name)))
            .when(~alone & shut & (F.when(depth > 0, top) != name), fault("crossed", F.array(name, F.when(depth > 0, top))))
            .otherwise(none)
        )
        stack = F.when(alone | found.isNotNull(), acc["stack"]).when(shut, F.slice(acc["stack"], 1, F.greatest(depth - 1, F.lit(0)))).otherwise(F.concat(acc["stack"], F.array(name)))
        return F.struct(stack.alias("stack"), found.alias("fault"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), none.alias("fault"))
    walked = F.aggregate(signs, start, step)
    opened = F.transform(F.filter(signs, lambda s: F.substring(s, 2, 1) != "/"), _name)
    missing = F.array_except(ids, opened)
    repeated = F.filter(ids, lambda i: F.size(F.filter(opened, lambda o: o == i)) > 1)
    return (
        F.when(F.size(invented) > 0, fault("invented", invented))
        .when(walked["fault"].isNotNull(), walked["fault"])
        .when(F.size(walked["stack"]) > 0, fault("unclosed", F.slice(walked["stack"], -1, 1)))
        .when(F.size(missing) > 0, fault("missing", missing))
        .when(F.size(repeated) > 0, fault("repeated", repeated))
    )


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def restored(ids: Column, opens: Column, shuts: Column, answer: Column) -> Column:
    """An answer as markup: signs as what they stand for, invented ones left out, all other text escaped."""
    answer = F.coalesce(answer, F.lit(""))
    signs = F.regexp_extract_all(answer, F.lit(SIGN), F.lit(0))
    sources = F.map_from_arrays(F.concat(ids, F.transform(ids, lambda i: F.concat(F.lit("/"), i))), F.concat(opens, F.zip_with(shuts, opens, lambda s, o: F.coalesce(s, o))))
    body = F.transform(signs, lambda s: F.coalesce(sources[F.regexp_replace(s, "[⟦⟧]", "")], F.lit("")))
    return F.array_join(F.zip_with(F.split(escaped(answer), SIGN, -1), body, lambda t, s: F.concat(t, F.coalesce(s, F.lit("")))), "")
