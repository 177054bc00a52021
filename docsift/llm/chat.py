"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template.

A template names the strings around a turn, the roles that may follow each other, the roles that may end a
conversation, and the roles whose text counts for the loss. Everything is a Column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Every control string starts with ``<|``, which escaped texts never contain."""

    turn_start: str = "<|im_start|>"
    header_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    # which roles may follow a role; "" is the start of a conversation
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final_roles: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escaped(text: Column) -> Column:
    r"""``<|`` becomes ``<\|``; where backslashes already stand between the two, one more is put in."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _segments(turn: Column, template: Template) -> Column:
    header = F.concat(F.lit(template.turn_start), F.url_encode(turn["role"]), F.lit(template.header_end))
    loss = turn["role"].isin(*template.loss_roles)
    return F.array(
        F.struct(header.alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(turn["text"]).alias("text"), loss.alias("loss")),
        F.struct(F.lit(template.turn_end).alias("text"), F.lit(False).alias("loss")),
    )


def _first_break(roles: Column, template: Template) -> Column:
    """Runs the state machine: number of the first turn that may not stand there, null if there is none."""
    allowed = F.create_map(*[
        part for role, followers in template.transitions.items() for part in (F.lit(role), F.array(*map(F.lit, followers)))
    ])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broke"))

    def step(seen: Column, role: Column) -> Column:
        fits = F.coalesce(F.array_contains(allowed[seen["state"]], role), F.lit(False))
        broke = F.coalesce(seen["broke"], F.when(~fits, seen["at"]))
        return F.struct(role.alias("state"), (seen["at"] + 1).alias("at"), broke.alias("broke"))

    return F.aggregate(roles, start, step)["broke"]


def formatted(
    turns: DataFrame, conversation: str, turn: str, role: str, text: str, template: Template = CHAT
) -> DataFrame:
    """One row per conversation: ``conversation``, ``segments`` (text, loss), ``formatted``, ``valid``, ``first_break``.

    ``formatted`` is the segments' text in one string. Control strings inside of texts are escaped reversibly, roles
    are URL-encoded (which changes no plain name). ``valid``: the order of roles is one that the template allows, to the
    end; ``first_break``: the first turn (from 0) that may not follow, null if there is none. Invalid conversations are
    formatted all the same.

    Null texts and roles count as empty. Turns are put in order by number (null first), then role, then text, and
    repeated rows are turns of their own. Rows with a null conversation are one conversation. A conversation is one
    value of the result, so that one has to fit a row; its turns are collected in one task for that.
    """
    rows = turns.select(
        turns[f"`{conversation}`"].alias("conversation"), turns[f"`{turn}`"].alias("turn"),
        F.coalesce(turns[f"`{role}`"], F.lit("")).alias("role"), F.coalesce(turns[f"`{text}`"], F.lit("")).alias("text"),
    )
    grouped = rows.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    broke = _first_break(F.transform("turns", lambda t: t["role"]), template)
    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    done = grouped.select("conversation", segments.alias("segments"), broke.alias("first_break"), F.element_at("turns", -1)["role"].alias("last"))
    return done.select(
        "conversation", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("first_break").isNull() & F.col("last").isin(*template.final_roles)).alias("valid"), "first_break",
    )


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"


def read_back(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """``conversation``, ``turns`` (role, text) read from ``formatted``, and ``loss_texts`` from the flagged segments."""
    pattern = F.lit(f"(?s){_quoted(template.turn_start)}([^\\n]*){_quoted(template.header_end)}(.*?){_quoted(template.turn_end)}")
    roles = F.transform(F.regexp_extract_all("formatted", pattern, F.lit(1)), F.url_decode)
    texts = F.transform(F.regexp_extract_all("formatted", pattern, F.lit(2)), unescaped)
    flagged = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return chats.select("conversation", "formatted", "valid", turns.alias("turns"), flagged.alias("loss_texts"))


def digests(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """Counts and SHA-256 digests of what ``read_back`` finds."""
    back = read_back(chats, template)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conversation", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
