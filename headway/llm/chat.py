"""Chat formatting with typed content parts.

A turn's content is an array of parts (kind, text, ref, units). ``PartVisitor`` has a
method for each kind and flattens a part into what the model reads: text is escaped, an
attachment becomes an ordered placeholder ``<|kind:turn.k|>`` and is recorded with its
reference and the number of tokens that it expands to. Turns are marked

    <|im_start|>role LF content <|im_end|> LF

Inside texts and roles ``\\`` becomes ``\\\\`` and ``|`` becomes ``\\|`` (and LF in a role
``\\n``), so no control string can come from a text, and ``unescape`` restores it.

The output has a row per turn, so no conversation, however long, is gathered to format
it: conv_id, turn, seq (order of equal turns), formatted, mask_start and mask_length (the
assistant's content, in code points of ``formatted``), attachments, n_attachment_tokens.

Defined cases: a null text or content is empty; a null role is an empty role; rows of one
turn are ordered by role, then content; repeated rows are repeated turns; a null conv_id
is a conversation of its own; an unknown kind is shown as text; negative or null units
count as zero; other columns are ignored; an empty table gives an empty output.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,units:double>"
#: Tokens of an attachment per unit (image: 14-pixel patches; audio: seconds; document: pages).
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


class PartVisitor:
    """Turns one part into struct(shown, kind, ref, tokens); subclasses override a kind."""

    def __init__(self, turn: Column, rates: dict[str, int] | None = None):
        self.turn = turn
        self.rates = rates or TOKENS_PER_UNIT

    def _result(self, shown: Column, kind: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(shown.alias("shown"), kind.alias("kind"), ref.alias("ref"), tokens.cast("long").alias("tokens"))

    def visit_text(self, part: Column, k: Column) -> Column:
        none = F.lit(None).cast("string")
        return self._result(escape(part["text"]), F.lit("text"), none, F.lit(0))

    def _attachment(self, kind: str, part: Column, k: Column) -> Column:
        name = F.concat(F.lit(f"<|{kind}:"), F.coalesce(self.turn.cast("string"), F.lit("")), F.lit("."),
                        k.cast("string"), F.lit("|>"))
        units = F.greatest(F.coalesce(part["units"], F.lit(0.0)), F.lit(0.0))
        return self._result(name, F.lit(kind), part["ref"], F.ceil(units * self.rates[kind]))

    def visit_image(self, part: Column, k: Column) -> Column:
        return self._attachment("image", part, k)

    def visit_audio(self, part: Column, k: Column) -> Column:
        return self._attachment("audio", part, k)

    def visit_document(self, part: Column, k: Column) -> Column:
        return self._attachment("document", part, k)

    def visit(self, part: Column, k: Column) -> Column:
        """Dispatch on the part's kind."""
        return (F.when(part["kind"] == "image", self.visit_image(part, k))
                .when(part["kind"] == "audio", self.visit_audio(part, k))
                .when(part["kind"] == "document", self.visit_document(part, k))
                .otherwise(self.visit_text(part, k)))


def text_parts(text: Column) -> Column:
    """A plain text as content of a single text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            none.cast("string").alias("ref"), none.cast("double").alias("units")))


def format_turns(turns: DataFrame, visitor: type[PartVisitor] = PartVisitor) -> DataFrame:
    """Format (conv_id, turn, role, parts): one output row a turn, sorted in ranges of (conv_id, turn).

    Everything is a built-in expression on the turn's own row. The range shuffle splits a
    conversation that holds many of the rows over several tasks.
    """
    v = visitor(F.col("turn"))
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    d = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    d = d.withColumn("_seen", F.transform("parts", lambda p, k: v.visit(p, k)))
    d = d.withColumn("_body", F.array_join(F.transform("_seen", lambda s: s["shown"]), ""))
    d = d.withColumn("_head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    before = lambda k: F.aggregate(F.slice("_seen", F.lit(1), k), F.lit(0),
                                   lambda a, s: a + F.length(s["shown"]))
    spoken = F.col("role") == "assistant"
    d = d.select(
        "conv_id", "turn", F.concat("_head", "_body", F.lit(END + "\n")).alias("formatted"),
        F.when(spoken, F.length("_head")).cast("long").alias("mask_start"),
        F.when(spoken, F.length("_body")).cast("long").alias("mask_length"),
        F.filter(F.transform("_seen", lambda s, k: F.struct(
            s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens"),
            (F.length("_head") + before(k)).cast("long").alias("offset"))),
            lambda x: x["kind"] != "text").alias("attachments"),
        F.aggregate("_seen", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]).alias("n_attachment_tokens"))
    order = ["conv_id", "turn", "formatted"]
    return d.repartitionByRange(*order).sortWithinPartitions(*order)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and content of one formatted turn, unescaped (placeholders stay as they are)."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def _digests(batches):
    """Running digests over rows sorted by conversation; a conversation may span batches."""
    open_, state = False, None
    names = [f.split()[0] for f in DIGEST.split(", ")]

    def close():
        conv, n, turns, chars, loss, total = state
        return dict(zip(names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)))

    for b in batches:
        done = []
        for conv, text, start, length in zip(*(b.column(c).to_pylist() for c in (
                "conv_id", "formatted", "mask_start", "mask_length"))):
            if not open_ or conv != state[0]:
                if open_:
                    done.append(close())
                open_, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, content = parse_turn(text)
            state[1] += 1
            state[2].update(f"{role}\n{content}\n".encode())
            if start is not None:
                said = unescape(text[start:start + length])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        yield pa.RecordBatch.from_pylist(done, schema=_schema())
    if open_:
        yield pa.RecordBatch.from_pylist([close()], schema=_schema())


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(c, kinds[t]) for c, t in (f.split() for f in DIGEST.split(", "))])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse an output written by ``format_turns``: digests per conversation.

    A SHA-256 digest runs through its text in order, so one task streams a whole
    conversation, batch by batch; it holds two hash states, never the conversation.
    """
    order = ["conv_id", "turn", "formatted"]
    d = formatted.select(*order, "mask_start", "mask_length").repartition("conv_id").sortWithinPartitions(*order)
    return d.mapInArrow(_digests, DIGEST)
