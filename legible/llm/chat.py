"""Chat formatting by a grammar round trip (op 11) [native: built-in functions only].

Grammar of a formatted conversation::

    conversation = turn*
    turn         = START role "\\n" text END "\\n"

The parser is deterministic: a turn begins at each START, its role ends at the first line break, its text at the
first END, and both are then unescaped.  A turn is rendered as it is, parsed, and compared with its source; only a
turn that does not come back is escaped (one step always suffices, see below).  Control strings hold one ``<``, their
first character, so none forms where turns meet; still the assembled conversation is parsed and compared as a whole,
and a difference is an error, never a silent result.

Escapes.  In a text every control string whose ``<`` is followed by n backslashes gets n + 1 (``<|im_end|>`` becomes
``<\\|im_end|>``, that becomes ``<\\\\|im_end|>``), so no control string is left and one step back restores the text.
In a role a backslash is doubled, a line break becomes ``\\n`` and ``<`` becomes ``\\l``.

Edge cases: null text and null role are empty; a null turn comes first; rows that share a turn are ordered by role,
then text, and all stay; a null conversation id is one conversation; extra columns are not read; an empty table gives
no row.  A conversation is one value, so its formatted text must fit one (2 GB); escaping and the first comparison
run on single rows before the shuffle, and rows travel once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control names (written ``<|name|>``) and the roles whose texts are trained on."""
    start: str = "im_start"
    end: str = "im_end"
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not all(n.replace("_", "a").isalnum() for n in (self.start, self.end)) or self.start == self.end:
            raise ValueError("control names are two different words of letters, digits and underscores")

    @property
    def opens(self) -> str:
        return f"<|{self.start}|>"

    @property
    def closes(self) -> str:
        return f"<|{self.end}|>"

    @property
    def names(self) -> str:
        return f"\\Q{self.start}\\E|\\Q{self.end}\\E"


CHATML = Template()
SLASH = "\\"


def escape_text(text: Column, t: Template = CHATML) -> Column:
    return F.regexp_replace(text, rf"<(\\*)\|({t.names})\|>", r"<\\$1|$2|>")


def unescape_text(text: Column, t: Template = CHATML) -> Column:
    return F.regexp_replace(text, rf"<\\(\\*)\|({t.names})\|>", "<$1|$2|>")


def escape_role(role: Column) -> Column:
    x = F.replace(role, F.lit(SLASH), F.lit(SLASH * 2))
    return F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    pieces = F.split(role, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")))
    return F.array_join(plain, SLASH)


def _header(role: Column, t: Template) -> Column:
    return F.concat(F.lit(t.opens), role, F.lit("\n"))


def render_turn(role: Column, text: Column, t: Template = CHATML) -> Column:
    return F.concat(_header(role, t), text, F.lit(t.closes + "\n"))


def parse_turns(formatted: Column, t: Template = CHATML) -> Column:
    """Turns of a formatted text as an array of (role, text); a stretch that breaks the grammar gives a null turn."""
    body = F.substring(formatted, len(t.opens) + 1, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        raw = F.substring_index(F.substr(x, F.length(role) + 2), t.closes, 1)
        good = x == F.concat(role, F.lit("\n"), raw, F.lit(t.closes + "\n"))
        return F.when(good, F.struct(unescape_role(role).alias("role"), unescape_text(raw, t).alias("text")))

    turns = F.transform(F.split(body, "\\Q%s\\E" % t.opens, -1), turn)
    none = F.array().cast("array<struct<role:string,text:string>>")
    return F.when(formatted == "", none).when(F.startswith(formatted, F.lit(t.opens)), turns).otherwise(F.array(F.lit(None)).cast(
        "array<struct<role:string,text:string>>"))


def format_chats(rows: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, formatted, spans, n_escaped.

    ``spans`` has one (begin, start, stop, loss) per turn, code-point offsets from 0: the turn begins at ``begin``, its
    text lies in [start, stop), ``loss`` says whether that text is trained on.  Reading a conversation that does not parse to its source raises."""
    t = template
    src = rows.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_n"),
                      F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a turn on its own: parsed back as it is, or escaped
    back = parse_turns(render_turn(F.col("role"), F.col("text"), t), t)
    source = F.array(F.struct("role", "text"))
    src = src.withColumn("_esc", ~back.eqNullSafe(source))

    def parts(role: Column, text: Column, escaped: Column) -> tuple[Column, Column]:
        return (F.when(escaped, escape_role(role)).otherwise(role), F.when(escaped, escape_text(text, t)).otherwise(text))

    # offsets: a running sum in the conversation's order; the window and the grouping share one exchange
    r, x = parts(F.col("role"), F.col("text"), F.col("_esc"))
    order = Window.partitionBy("_c").orderBy("_n", "role", "text")
    src = (src.withColumn("_head", F.length(_header(r, t)).cast("long")).withColumn("_len", F.length(x).cast("long"))
           .withColumn("_k", F.row_number().over(order))
           .withColumn("_end", F.sum(F.col("_head") + F.col("_len") + F.lit(len(t.closes) + 1)).over(
               order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    turns = F.sort_array(F.collect_list(F.struct("_k", "role", "text", "_esc", "_head", "_len", "_end")))
    conv = src.groupBy("_c").agg(turns.alias("_t"))

    formatted = F.array_join(F.transform("_t", lambda u: render_turn(*parts(u["role"], u["text"], u["_esc"]), t)), "")
    source_turns = F.transform("_t", lambda u: F.struct(u["role"].alias("role"), u["text"].alias("text")))

    def span(u: Column) -> Column:
        start = u["_end"] - F.lit(len(t.closes) + 1) - u["_len"]
        return F.struct((start - u["_head"]).alias("begin"), start.alias("start"), (start + u["_len"]).alias("stop"),
                        u["role"].isin(*t.loss_roles).alias("loss"))

    conv = conv.withColumn("formatted", formatted)
    same = parse_turns(F.col("formatted"), t).eqNullSafe(source_turns)
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse to its source")))
    return conv.select(F.col("_c").alias(conv_col), F.size("_t").cast("long").alias("n_turns"), checked.alias("formatted"),
                       F.transform("_t", span).alias("spans"),
                       F.size(F.filter("_t", lambda u: u["_esc"])).cast("long").alias("n_escaped"))


def loss_texts(formatted: Column, spans: Column, t: Template = CHATML) -> Column:
    """What stands under the loss mask, unescaped, one string per masked span; each span is read inside its own turn."""
    pieces = F.split(formatted, "(?=\\Q%s\\E)" % t.opens, -1)

    def read(piece: Column, span: Column) -> Column:
        at, size = span["start"] - span["begin"] + 1, span["stop"] - span["start"]
        return F.when(span["loss"], unescape_text(F.substr(piece, at.cast("int"), size.cast("int")), t))

    return F.filter(F.zip_with(pieces, spans, read), lambda x: x.isNotNull())
