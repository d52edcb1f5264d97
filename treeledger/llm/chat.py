"""Chat formatting with DataFrame functions only.

A declarative template gives each role an opening and a closing mark.  ``format_chats`` puts the turns of a conversation
in order, runs a finite-state machine over their roles and writes one string with its segments and their loss flags;
``read_chats`` reads turns and loss text back from that string alone.

Control strings inside texts are escaped: a backslash becomes ``\\0`` and the first character of a control string becomes
a backslash and its digit, so that no control string stands in an escaped text and unescaping gives back every text.

Defined results: null texts and roles are empty; turns with one number are ordered by role and text; a null turn comes
first; a null conv_id is a conversation of its own; roles that the template doesn't know get the generic mark, with the
role inside; invalid role orders are formatted as they are and flagged (``valid``, ``first_bad``); repeated rows stay;
an empty table gives an empty result; other columns are ignored.

One row holds a whole conversation, since a conversation's digest is over its whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: (role, opening, closing, whether the text counts for the loss); generic: for other roles, opened with the role.

    moves: the finite-state machine, (state, role) to the next state; a conversation is valid if each turn has a move and
    the last state is in ends.
    """

    marks: tuple[tuple[str, str, str, bool], ...] = (
        ("system", "<<SYS>>", "<</SYS>>", False),
        ("user", "[INST]", "[/INST]", False),
        ("assistant", "<s>", "</s>", True),
    )
    generic: tuple[str, str, str] = ("[TURN:", "]", "[/TURN]")
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    ends: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        return sorted({x for _, lo, hi, _ in self.marks for x in (lo, hi)} | {self.generic[0], self.generic[2]}, key=lambda x: (-len(x), x))

    def codes(self) -> dict[str, str]:
        """The first characters of control strings, each with its escape; the backslash has \\0 and a closing bracket its own."""
        firsts = sorted({x[0] for x in self.controls()} | {self.generic[1]})
        if len(firsts) > 9 or "\\" in firsts:
            raise ValueError("control strings must begin with at most 9 characters other than the backslash")
        return {c: f"\\{i}" for i, c in enumerate(firsts, 1)}


def _java(text: str) -> str:
    return "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in text)


def escape(text: Column, t: Template, whole: bool = False) -> Column:
    """Escapes control strings of a text; whole: every character that could end a role mark too."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c, code in t.codes().items():
        if whole:
            out = F.replace(out, F.lit(c), F.lit(code))
            continue
        rests = [_java(x[1:]) for x in t.controls() if x[0] == c]
        if rests:
            out = F.regexp_replace(out, f"{_java(c)}(?={'|'.join(rests)})", code.replace("\\", "\\\\"))
    return out


def unescape(text: Column, t: Template) -> Column:
    out = text
    for c, code in t.codes().items():
        out = F.replace(out, F.lit(code), F.lit(c))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def _by_role(role: Column, pick, other: Column, t: Template) -> Column:
    out = None
    for name, lo, hi, loss in t.marks:
        value = F.lit(pick(lo, hi, loss))
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other)


def format_chats(turns: DataFrame, t: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss), valid, first_bad (index of the first turn without a move)."""
    t = t or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opened = _by_role(role, lambda lo, hi, loss: lo, F.concat(F.lit(t.generic[0]), escape(role, t, True), F.lit(t.generic[1])), t)
    parts = turns.select("conv_id", "turn", role.alias("role"), text.alias("raw"), opened.alias("open"), escape(text, t).alias("text"), _by_role(role, lambda lo, hi, loss: hi, F.lit(t.generic[2]), t).alias("close"), _by_role(role, lambda lo, hi, loss: loss, F.lit(False), t).alias("loss"))
    chats = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "raw", "open", "text", "close", "loss"))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, r), to in t.moves.items() for x in (f"{state}\0{r}", to)])

    def step(acc: Column, x: Column) -> Column:
        to = F.coalesce(F.element_at(moves, F.concat(acc["state"], F.lit("\0"), x["role"])), F.lit(""))  # "": no move, nor from here
        bad = to == ""
        return F.struct(to.alias("state"), (acc["n"] + 1).alias("n"), F.when(acc["bad"].isNotNull(), acc["bad"]).when(bad, acc["n"]).alias("bad"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    run = F.aggregate("turns", start, step)
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda x: F.array(F.struct(x["open"].alias("text"), no.alias("loss")), F.struct(x["text"].alias("text"), x["loss"].alias("loss")), F.struct(x["close"].alias("text"), no.alias("loss")))))
    return chats.select("conv_id", segments.alias("segments"), run.alias("run")).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        "segments",
        F.col("run.state").isin(*t.ends).alias("valid"),
        F.col("run.bad").alias("first_bad"),
    )


def read_chats(chats: DataFrame, t: Template | None = None) -> DataFrame:
    """chats with turns (array of role and text), read from formatted, and loss_text, read from segments."""
    t = t or Template()
    closes = "|".join(_java(x) for x in sorted({hi for _, _, hi, _ in t.marks} | {t.generic[2]}, key=lambda x: -len(x)))

    def turn(x: Column) -> Column:
        rest = F.substring_index(F.substr(x, F.lit(len(t.generic[0]) + 1)), t.generic[1], 1)
        role = F.lit(None).cast("string")
        skip = F.lit(len(t.generic[0]) + len(t.generic[1])) + F.length(rest)
        for name, lo, _, _ in reversed(t.marks):
            role = F.when(F.startswith(x, F.lit(lo)), F.lit(name)).otherwise(role)
            skip = F.when(F.startswith(x, F.lit(lo)), F.lit(len(lo))).otherwise(skip)
        return F.struct(F.coalesce(role, unescape(rest, t)).alias("role"), unescape(F.substr(x, skip + 1), t).alias("text"))

    parts = F.split("formatted", closes, -1)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)  # nothing stands behind the last closing mark
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: x["text"]), ""), t)
    return chats.withColumns({"turns": turns, "loss_text": loss})


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    got = read_chats(format_chats(rows.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: formatted_chars: marks, text, and one character more for each backslash and control string.
ORACLE_OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[TURN:', ''))) // 6 + (length(text) - length(replace(text, '[/TURN]', ''))) // 7
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END AS formatted
  FROM rows),
chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    string_agg(role, ',' ORDER BY turn, role, text) AS roles, sum(formatted) AS formatted
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars, regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM chats
"""
