"""Scalar text functions as Columns. Lengths and offsets are code points; patterns avoid the traps of ``$``, ``\\s`` and ``\\b``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
BLANK = " \t\n\x0b\x0c\r"
#: The same with the blanks of other scripts, and as the inside of a character class.
WIDE_BLANK = BLANK + "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WIDE_CLASS = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Superscript digits and the digits they stand for.
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
#: Signs that end a sentence.
SENTENCE_ENDS = (".", "!", "?", ":", '"', "”")
#: The five XML entities.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def trim_wide(c: Column) -> Column:
    return F.btrim(c, F.lit(WIDE_BLANK))


def strip_bom(c: Column) -> Column:
    """One leading byte-order mark at most."""
    return F.regexp_replace(c, "\\A\\x{FEFF}", "")


def furniture_key(c: Column) -> Column:
    """Upper case, letters and digits only, each run of digits as one #."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "[0-9]+", "#")


def escape_xml(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape_xml(c: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def strip_illegal_xml(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]", "")


def inline_markup(c: Column) -> Column:
    """Escaped text with **strong**, *emphasis* and line breaks as elements."""
    out = F.regexp_replace(escape_xml(c), r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?<!\*)\*([^*\n]+)\*(?!\*)", "<em>$1</em>")
    return F.replace(out, F.lit("\n"), F.lit("<br/>\n"))


def plain_text(c: Column) -> Column:
    """Tags off, entities back, trimmed."""
    return trim_all(unescape_xml(F.regexp_replace(c, "<[^>]*>", "")))


def _number(digits: Column) -> Column:
    """Digits as an int, or null. A cast that fails makes an exception each time, so what holds none is not cast."""
    return F.when(digits != "", digits.try_cast("int"))


def superscript_number(c: Column) -> Column:
    return _number(F.translate(F.regexp_extract(c, f"[{SUPERSCRIPTS}]+", 0), SUPERSCRIPTS, DIGITS))


def note_lead(c: Column) -> Column:
    """The printed number a note opens with: a superscript run, or up to three digits before a blank."""
    raised = F.translate(F.regexp_extract(c, rf"\A([{SUPERSCRIPTS}]+)", 1), SUPERSCRIPTS, DIGITS)
    plain = F.regexp_extract(c, r"\A([0-9]{1,3})[ \t]", 1)
    return F.when(F.substring(c, 1, 1).isin(*SUPERSCRIPTS), raised.try_cast("int")).otherwise(_number(plain))


def word_count(c: Column) -> Column:
    """Words after emphasis marks have become blanks."""
    return _words(c, "*_")


def plain_word_count(c: Column) -> Column:
    """Words as they stand; emphasis marks are part of them."""
    return _words(c, "")


def _words(c: Column, more: str) -> Column:
    # behind a word that is not counted no blank opens the text, so none of the parts is empty
    return (F.size(F.split(F.rtrim(F.concat(F.lit("x "), c), F.lit(BLANK + more)), rf"[ \t\n\x0B\f\r{more}]+")) - 1).cast("long")


def heading_label(c: Column) -> Column:
    """Trimmed lines joined by ': ', or by a space where what stands before ends in punctuation."""
    lines = F.filter(F.transform(F.split(c, "\n"), trim_all), lambda s: s != "")
    return F.aggregate(
        lines,
        F.lit(""),
        lambda acc, s: F.when(acc == "", s).when(acc.rlike(r"[.,:;!?…—–-]\z"), F.concat(acc, F.lit(" "), s)).otherwise(F.concat(acc, F.lit(": "), s)),
    )


def trailing_hyphen_word(c: Column) -> Column:
    bare = F.rtrim(c, F.lit(BLANK))
    return F.when(~F.endswith(bare, F.lit("-")), "").otherwise(F.regexp_extract(bare, r"([A-Za-zÀ-ÿ]+)-\z", 1))


def leading_word(c: Column) -> Column:
    return F.regexp_extract(c, r"\A[A-Za-zÀ-ÿ]+", 0)


def goes_on(c: Column) -> Column:
    """The text does not end a sentence."""
    return (c != "") & ~F.substring(F.rtrim(c, F.lit(BLANK)), -1, 1).isin(*SENTENCE_ENDS)


def opens_low(c: Column) -> Column:
    """The text opens with a letter in lower case."""
    first = F.substring(c, 1, 1)
    return (c != "") & (F.upper(first) != first)


def continues_textually(before: Column, after: Column) -> Column:
    """A sentence goes on: the text before does not end one, and the text after opens with a letter in lower case."""
    return goes_on(before) & opens_low(after)


def wrapped_prose(c: Column) -> Column:
    """Text with line breaks and no blank line, whose lines but the last have 45 characters at least, and whose breaks do
    not all end sentences (for three wrapped lines or more)."""
    lines = F.split(c, "\n")
    wrapped = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    ends = F.forall(wrapped, lambda s: F.rtrim(s).rlike("[.!?][\"'*”’)]?\\z"))
    return (F.size(lines) > 1) & ~F.exists(lines, lambda s: trim_all(s) == "") & F.forall(wrapped, lambda s: F.char_length(s) >= 45) & ~((F.size(wrapped) >= 3) & ends)


def reflowed(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\n")) & wrapped_prose(c), F.regexp_replace(c, "[ \\t]*\\n[ \\t]*", " ")).otherwise(c)


def flatten_table(c: Column) -> Column:
    """A table's markup as lines: a row ends a line, other tags are blanks."""
    return trim_all(F.regexp_replace(F.regexp_replace(c, "(?i)</tr>", "\n"), "<[^>]*>", " "))


def unfenced(c: Column) -> Column:
    """One code fence around the whole text is taken off."""
    return F.regexp_replace(c, r"(?s)\A[ \t\n\x0B\f\r]*```[^\n]*\n(.*?)\n?```[ \t\n\x0B\f\r]*\z", "$1")


def unfenced_json(c: Column) -> Column:
    """Without an opening code fence (named json or not) and without a closing one, each on its own, and trimmed."""
    opened = F.regexp_replace(c, rf"(?i)\A[{WIDE_CLASS}]*```(?:json)?[{WIDE_CLASS}]*", "")
    return trim_wide(F.regexp_replace(opened, rf"```[{WIDE_CLASS}]*\z", ""))


def json_value(c: Column) -> Column:
    """The VARIANT of a JSON text, or null where it is none. The text is parsed as the member of an object, so that nothing
    can stand behind it."""
    whole = F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit(',"z":1}')))
    names = F.array_sort(F.map_keys(F.try_variant_get(whole, "$", "map<string,variant>")))
    return F.when(names == F.array(F.lit("a"), F.lit("z")), F.try_variant_get(whole, "$.a", "variant"))


#: Characters of two UTF-16 units.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _ascii(c: Column) -> Column:
    """Whether each character is one byte, which needs no look at the characters."""
    return F.octet_length(c) == F.char_length(c)


def utf16_length(c: Column) -> Column:
    return F.char_length(c) + F.when(_ascii(c), 0).otherwise(F.char_length(F.regexp_replace(c, ASTRAL.replace("[", "[^"), "")))


def point_of_unit(c: Column, unit: Column) -> Column:
    """The code points before a UTF-16 offset of the text: each character of two units before it counts once."""
    return F.when(~_ascii(c) & c.rlike(ASTRAL), unit - F.size(F.filter(match_spans(c, ASTRAL), lambda s, k: s["at"] + k < unit))).otherwise(unit)


def strip_markers(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(c, "⟦[^⟧]*⟧", ""), r"[ \t\n\x0B\f\r]+", " "))


def bank_key(*fields: Column) -> Column:
    """SHA-256 over the fields, parted by NUL."""
    return F.sha2(F.concat_ws("\x00", *fields), 256)


def short_sha(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def printed_page(c: Column) -> Column:
    """A page label without its prefix."""
    return trim_all(F.regexp_replace(F.lower(trim_all(c)), r"\A(page|pg\.?|p\.|seite|s\.)[ \t]*", ""))


def text_weight(c: Column) -> Column:
    return F.greatest(F.lit(1), F.char_length(trim_all(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")))).cast("long")


def answer_budget(c: Column) -> Column:
    return F.greatest(F.lit(128), F.ceil(F.char_length(c) * 4 / 2.5)).cast("long")


def joined_word(stem: Column, word: Column, knows_fused: Column, knows_compound: Column) -> Column:
    """A word that was broken at a hyphen: fused if the book has it so, with its hyphen if it has the compound, else fused
    where the second half opens in lower case."""
    first = F.substring(word, 1, 1)
    return F.when(knows_fused | (~knows_compound & (F.lower(first) == first)), F.concat(stem, word)).otherwise(F.concat(stem, F.lit("-"), word))


def unemphasised(c: Column) -> Column:
    """Emphasis signs as blanks, trimmed."""
    return trim_all(F.translate(c, "*_", "  "))


def match_spans(c: Column, pattern: str) -> Column:
    """array<struct<at, len, hit>> of a pattern's matches, offsets in code points: a match starts after all text between
    matches and all matches before it."""

    def placed(both):
        ends = F.aggregate(both, F.expr("cast(array() as array<int>)"), lambda acc, b: F.array_append(acc, F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(0) + F.char_length(b["hit"]) + F.char_length(b["rest"])))
        return F.zip_with(both, ends, lambda b, end: F.struct((end - F.char_length(b["hit"])).alias("at"), F.char_length(b["hit"]).alias("len"), b["hit"].alias("hit")))

    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    both = F.transform(F.arrays_zip(hits.alias("hit"), F.split(c, pattern, -1).alias("rest")), lambda b: b)
    return F.element_at(F.transform(F.array(F.filter(both, lambda b: b["hit"].isNotNull())), placed), 1)


def chunk_ambiguity(parts: Column, kind: Column) -> Column:
    """Why parts cannot be told apart once rendered, or null: a line break in one, a bar in a table cell, a number that opens
    a list item, or nothing at all in a row."""
    has = lambda pattern: F.exists(parts, lambda p: p.rlike(pattern))
    return F.when(has("\n"), "line break").when((kind == "table") & has(r"\|"), "bar").when((kind != "table") & has(r"\A[ \t]*[0-9]+[ \t]*[.):]"), "number").when((kind == "table") & F.forall(parts, lambda p: trim_all(p) == ""), "empty row")


def resolved_href(base: Column, href: Column) -> Column:
    """A reference as a path within the package: percent signs decoded, . and .. folded, the fragment left off."""
    path = F.try_url_decode(F.replace(F.regexp_extract(href, r"\A([^#?]*)", 1), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(base, r"\A(.*/)?[^/]*\z", 1)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    start = F.expr("cast(array() as array<string>)")

    def step(acc, p):
        return F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))

    return F.array_join(F.aggregate(F.split(whole, "/"), start, step), "/")


def language_tag(c: Column) -> Column:
    """The tag in its usual case if it has the shape of one, else null."""
    tag = trim_all(c)
    parts = F.split(F.replace(F.lower(tag), F.lit("_"), F.lit("-")), "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, p).when(F.char_length(p) == 4, F.initcap(p)).when(F.char_length(p) == 2, F.upper(p)).otherwise(p))
    return F.when(tag.rlike(r"\A[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})*\z"), F.array_join(cased, "-"))
