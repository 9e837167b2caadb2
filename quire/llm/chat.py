"""Chat formatting: logs of streamed deltas, edits and regenerations are folded into messages and rendered.

A log row is (conv_id, seq, turn, slot, kind, role, text); a message is named by conversation, turn and slot (0 where a turn
has one message). Kinds, in the order of seq:

    open        the message begins, with its role and an empty text
    delta       text is added at its end
    edit        text takes the place of all its text so far
    regenerate  the message is emptied, and every message of a later turn loses what was logged before this row

A message is there if an open row of it lives. Logs are dealt by conversation and block of 64 turns and sorted by turn, slot
and seq, so a task holds one message and, as its conversation's state, the greatest seq of a regeneration so far; what the
blocks before hand on is one number a block. So a conversation with a third of all rows is spread over as many tasks as it has
blocks, and every piece of output is bounded by 64 turns and PIECE code points (or one message).

Template: ``### role: text</turn>`` and a line feed for each message. Within texts and roles a backslash goes before every
backslash, ``###`` and ``</turn>``, in roles before colons too, and comes off again, so no text can end its turn or begin
another. The loss mask is a list of spans [start, end) of code points of the formatted piece: the texts of assistants as they
are escaped there.

A null text or role is empty. A null turn counts as -1. Rows of one turn come in the order of role and text, repeated rows
once each. Rows of a null conv_id are one conversation. Other columns are left aside. An empty table gives the conversations
that are added by the caller, or no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

#: Turns of a block, as a power of two, and code points of a piece.
BLOCK_BITS, PIECE = 6, 4 << 20
#: Code points of a streamed delta in logs that are made from finished conversations.
DELTA = 256
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
LOG_SCHEMA = "conv_id long, seq long, turn long, slot long, kind string, role string, text string"
MESSAGE_SCHEMA = "conv_id long, turn long, slot long, role string, text string"
PIECE_SCHEMA = "conv_id long, block long, piece long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
MESSAGES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("slot", pa.int64()), ("role", pa.string()), ("text", pa.string())])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
PIECES = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", SPANS)])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescaped(text: str) -> str:
    return ESCAPE.sub(r"\1", text) if "\\" in text else text


def rendered_turn(role: str, text: str) -> tuple[str, int, int]:
    """The printed turn and where its text begins and ends in it."""
    head = HEAD + escaped(role).replace(":", "\\:") + COLON
    body = escaped(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def _mark(formatted: str, mark: str, start: int) -> int:
    """Where the next mark stands that no backslash escapes."""
    at = formatted.index(mark, start)
    while True:
        back = at
        while back > start and formatted[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at = formatted.index(mark, at + 1)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each printed turn; a ValueError where anything else stands."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn at code point {at}")
        colon = _mark(formatted, COLON, at + len(HEAD))
        body = colon + len(COLON)
        end = _mark(formatted, TAIL, body)
        yield unescaped(formatted[at + len(HEAD) : colon]), unescaped(formatted[body:end])
        at = end + len(TAIL)


# --- logs -------------------------------------------------------------------------------------------------------------


def log_of(conversations: DataFrame) -> DataFrame:
    """A log that gives these conversations (conv_id, turn, role, text). Texts are streamed in deltas; a third of the other
    messages are posted as a draft and edited; a quarter of the assistants' are begun, answered by the next turn and then
    generated anew, so that rows on both turns are void."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    tied = Window.partitionBy("conv_id", F.shiftright("turn", BLOCK_BITS)).orderBy("turn", "role", "text")
    # rows of one turn get slots of their own; the number within the block will do
    rows = rows.withColumn("slot", (F.row_number().over(tied) - 1).cast("long"))
    small = F.col("turn").between(1 - 2**31, 2**31 - 2)
    base = F.shiftleft(F.when(small, F.col("turn")).when(F.col("turn") > 0, 2**31 - 1).otherwise(-(2**31)), 32)
    chance = F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(12))

    def event(k: Column | int, kind: str, text: Column, turn: Column = F.col("turn"), slot: Column = F.col("slot"), role: Column = F.col("role")) -> Column:
        k = F.lit(k).cast("long") if isinstance(k, int) else k.cast("long")
        return F.struct((base + k).alias("seq"), turn.alias("turn"), slot.alias("slot"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    none, draft = F.lit(None).cast("string"), F.substring("text", 1, 40)
    begun = F.array(event(0, "open", none))
    edited = F.array(event(1, "delta", draft), event(2, "edit", F.col("text")))
    void = F.array(
        event(1, "delta", draft), event(2, "open", none, F.col("turn") + 1, F.lit(-1).cast("long"), F.lit("user")), event(3, "delta", F.lit("and then"), F.col("turn") + 1, F.lit(-1).cast("long")), event(4, "regenerate", none)
    )
    streamed = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda t, k: event(k + 5, "delta", t))
    assistant = F.col("role") == LOSS_ROLE
    events = F.when(~assistant & (chance < 4), F.concat(begun, edited)).when(assistant & (chance < 3) & small, F.concat(begun, void, streamed)).otherwise(F.concat(begun, streamed))
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.turn", "e.slot", "e.kind", "e.role", "e.text")


def _dealt(log: DataFrame) -> DataFrame:
    """The log by conversation and block in the order of the fold. A block begins with a row of kind carry, if a block before
    it has a regeneration: the greatest seq of those."""
    log = log.select(*[col(log, c).alias(c) for c in ("conv_id", "seq", "turn", "slot", "kind", "role", "text")])
    log = log.withColumn("block", F.shiftright("turn", BLOCK_BITS))
    blocks = log.groupBy("conv_id", "block").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("own"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", F.max("own").over(before).alias("seq"), F.shiftleft("block", BLOCK_BITS).alias("turn"), F.lit(-(2**63)).alias("slot"), "block").where("seq is not null")
    none = F.lit(None).cast("string")
    both = log.unionByName(carried.withColumns({"kind": F.lit("carry"), "role": none, "text": none}))
    return both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "slot", "seq")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, block, turn, slot, role, text) of each message, from rows in the order of the fold."""
    home = key = None
    cut, lately = None, None  # greatest regeneration of turns before this one, and of this one
    role, parts = None, []

    def message():
        return (key[0], key[1], key[2], key[3], role, "".join(parts))

    for batch in batches:
        names = ("conv_id", "block", "turn", "slot", "seq", "kind", "role", "text")
        for conv, block, turn, slot, seq, kind, said, text in zip(*(batch.column(n).to_pylist() for n in names)):
            now = (conv, block, turn, slot)
            if now != key:
                if role is not None:
                    yield message()
                if home != (conv, block):
                    home, cut, lately = (conv, block), None, None
                elif turn != key[2]:
                    cut = max((x for x in (cut, lately) if x is not None), default=None)
                    lately = None
                key, role, parts = now, None, []
            if kind == "carry":
                cut = seq
            elif cut is not None and seq < cut:
                continue
            elif kind == "open":
                role, parts = said or "", []
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
                lately = seq if lately is None else max(lately, seq)
            else:
                raise ValueError(f"unknown kind {kind!r}")
    if role is not None:
        yield message()


def _grouped_rows(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of code points (or one row)."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total > PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _messages(batches):
    rows = ((conv, turn, slot, role, text) for conv, _, turn, slot, role, text in _folded(batches))
    return _grouped_rows(rows, MESSAGES, lambda r: len(r[4]))


def fold_messages(log: DataFrame) -> DataFrame:
    """conv_id, turn, slot, role, text of every message that the log leaves."""
    return _dealt(log).mapInArrow(_messages, MESSAGE_SCHEMA)


def _rendered(messages: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, block, piece, n_turns, formatted, loss) from messages in order."""
    home, piece, parts, loss, length = None, 0, [], [], 0
    for conv, block, _, _, role, text in messages:
        if parts and (home != (conv, block) or length > PIECE):
            yield (*home, piece, len(parts), "".join(parts), loss)
            piece, parts, loss, length = piece + 1, [], [], 0
        if home != (conv, block):
            home, piece = (conv, block), 0
        printed, begin, end = rendered_turn(role, text)
        if role == LOSS_ROLE:
            loss.append({"start": length + begin, "end": length + end})
        parts.append(printed)
        length += len(printed)
    if parts:
        yield (*home, piece, len(parts), "".join(parts), loss)


def _pieces(batches):
    return _grouped_rows(_rendered(_folded(batches)), PIECES, lambda r: len(r[4]))


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, block, piece, n_turns, formatted, loss: a conversation is its pieces in order, end to end; loss spans count
    from the beginning of their piece."""
    return _dealt(log).mapInArrow(_pieces, PIECE_SCHEMA)


# --- reading back -----------------------------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        conv, state = None, None
        for batch in batches:
            for now, formatted, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss"))):
                if state is None or now != conv:
                    if state is not None:
                        yield (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
                    conv, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    learned = unescaped(formatted[span["start"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
        if state is not None:
            yield (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    return _grouped_rows(rows(), DIGESTS, lambda r: 200)


def chat_digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, from its formatted pieces alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is taken over a conversation from its beginning to its end, so the pieces of one conversation pass through one
    task; it holds one piece at a time."""
    ordered = pieces.select("conv_id", "block", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")
    return ordered.mapInArrow(_digests, DIGEST_SCHEMA)
