"""Chat and preference records: messages, rendering, deduplication, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, strip

#: Roles, markers and the heading of an instruction's input.
ROLES = ("system", "user", "assistant")
START, END, STOP = "<|im_start|>", "<|im_end|>", "<|endoftext|>"
INPUT_HEADING = "\n\n输入：\n"
IGNORED = -100
REQUIRED = {"instruction": {"instruction", "input", "output"}, "preference": {"prompt", "chosen", "rejected"}}


def require(df: DataFrame, kind: str) -> None:
    if missing := REQUIRED[kind] - set(df.columns):
        raise KeyError(f"columns are missing: {sorted(missing)}")


def message(role: str, content: Column) -> Column:
    """A message; blank content is an error when the row is computed."""
    text = strip(content)
    checked = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.raise_error(F.lit("blank message")).cast("string"))
    return F.struct(F.lit(role).alias("role"), checked.alias("content"))


def loose(c: Column) -> Column:
    """Any value as stripped text; null as none."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def _falsy(df: DataFrame, name: str) -> Column:
    """A value as stripped text; null, 0 and false as none."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind != "string":
        c = F.when(c.cast("double") != 0, c)
    return loose(c)


def instruction_messages(df: DataFrame) -> Column:
    """Messages of an instruction record; null without instruction or output."""
    require(df, "instruction")
    ask, more, answer = (_falsy(df, n) for n in ("instruction", "input", "output"))
    user = F.when(more != "", F.concat(ask, F.lit(INPUT_HEADING), more)).otherwise(ask)
    return F.when((ask != "") & (answer != ""), F.array(message("user", user), message("assistant", answer)))


def preference_messages(df: DataFrame) -> tuple[Column, Column]:
    """Chosen and rejected messages of a preference record; null unless prompt, chosen and rejected have text."""
    require(df, "preference")
    prompt, chosen, rejected = (loose(F.col(n)) for n in ("prompt", "chosen", "rejected"))
    system = loose(F.col("system")) if "system" in df.columns else F.lit("")
    head = F.when(F.lower(system).isin("", "none", "null"), F.array(message("user", prompt))).otherwise(F.array(message("system", system), message("user", prompt)))
    valid = (prompt != "") & (chosen != "") & (rejected != "")
    side = lambda c: F.when(valid, F.concat(head, F.array(message("assistant", c))))
    return side(chosen), side(rejected)


def render(messages: Column, generation_prompt: bool = False) -> Column:
    """Messages as the template has them; an unknown role is an error."""

    def one(m: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(m["role"], F.lit("null")))).cast("string")
        return F.when(m["role"].isin(*ROLES), F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))).otherwise(bad)

    text = F.array_join(F.transform(messages, one), "")
    return F.concat(text, F.lit(f"{START}assistant\n")) if generation_prompt else text


def segments(messages: Column) -> Column:
    """The rendered text in pieces, each marked whether it is the assistant's: its content with the end mark."""

    def one(m: Column) -> Column:
        own = m["role"] == "assistant"
        part = lambda text, is_own: F.struct(text.alias("text"), is_own.alias("assistant"))
        return F.array(part(F.concat(F.lit(START), m["role"], F.lit("\n")), F.lit(False)), part(F.concat(m["content"], F.lit(END)), own), part(F.lit("\n"), F.lit(False)))

    return F.flatten(F.transform(messages, one))


def clean_answer(c: Column) -> Column:
    return strip(F.substring_index(F.substring_index(c, END, 1), STOP, 1))


def answers_key(messages: Column) -> Column:
    """What makes two examples the same: the assistant's contents, white space collapsed."""
    return F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: collapse(m["content"]))


def marked(df: DataFrame, messages: str, order: list[str]) -> DataFrame:
    """df with skip_reason: invalid (no messages, or none of the assistant's), duplicate (an earlier valid row has
    the same answers), or null. The first row of a key is found by a minimum, not by ranking its rows."""
    valid = F.coalesce(F.exists(messages, lambda m: m["role"] == "assistant"), F.lit(False))
    df = df.withColumn("__valid", valid).withColumn("__key", F.when(valid, F.to_json(answers_key(F.col(messages)))))
    first = df.where("__valid").groupBy("__key").agg(F.min(F.struct(*order)).alias("__first"))
    joined = df.join(first, "__key", "left")
    reason = F.when(~F.col("__valid"), "invalid").when(F.struct(*order) != F.col("__first"), "duplicate")
    return joined.withColumn("skip_reason", reason).drop("__valid", "__key", "__first")


def skip_stats(df: DataFrame) -> DataFrame:
    """Examples by outcome (column skip_reason, null where kept): outcome, n, a row for each, zeros included."""
    names = ["kept", "invalid", "duplicate", "too_long"]
    one = df.agg(*(F.count_if(F.coalesce("skip_reason", F.lit("kept")) == n).alias(n) for n in names))
    return one.unpivot([], names, "outcome", "n")


def surviving_pairs(df: DataFrame, chosen: str, rejected: str, longest: int) -> DataFrame:
    """Preference rows both of whose sides (structs of ids and mask) fit, as the six arrays of paired training."""
    sides = {"chosen": F.col(chosen), "rejected": F.col(rejected)}
    fit = df.withColumns({f"__{k}": fitted(c["ids"], c["mask"], longest) for k, c in sides.items()}).where("__chosen IS NOT NULL AND __rejected IS NOT NULL")
    out = []
    for k, c in sides.items():
        ids, mask = (F.slice(c[x], F.lit(1), F.col(f"__{k}")) for x in ("ids", "mask"))
        out += [ids.alias(f"{k}_input_ids"), labels(ids, mask).alias(f"{k}_labels"), F.array_repeat(F.lit(1), F.col(f"__{k}")).alias(f"{k}_attention_mask")]
    return fit.select(*(c for c in df.columns if c not in (chosen, rejected)), *out)


def fitted(ids: Column, mask: Column, longest: int) -> Column:
    """How many tokens of an example stay: null if an assistant's token lies beyond longest, or none within."""
    beyond = F.exists(F.slice(mask, longest + 1, 1 << 30), lambda m: m == 1)
    within = F.exists(F.slice(mask, 1, longest), lambda m: m == 1)
    return F.when(~beyond & within, F.least(F.size(ids), F.lit(longest)))


def labels(ids: Column, mask: Column) -> Column:
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))


def padded(c: Column, width: Column, value: int) -> Column:
    return F.concat(c, F.array_repeat(F.lit(value), (width - F.size(c)).cast("int")))


def length_batches(df: DataFrame, position: str, length: str, batch: int, multiplier: int) -> DataFrame:
    """df with bucket and batch_id: position (from 0) cut in buckets of batch x multiplier, each sorted by length,
    then cut in batches."""
    per = batch * max(1, multiplier)
    df = df.withColumn("bucket", F.floor(F.col(position) / per).cast("long"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(length, position)) - 1
    return df.withColumn("batch_id", F.col("bucket") * max(1, multiplier) + F.floor(nth / batch).cast("long"))


def epoch_batches(df: DataFrame, id_: str, length: str, batch: int, multiplier: int, seed: int, epoch: int) -> DataFrame:
    """length_batches() of an epoch: rows in an order that seed and epoch decide, and with batch_order, by which
    batches are taken, decided so, too."""
    from .sampling import draw, ranked

    placed = ranked(df.withColumn("__key", F.concat(draw(f"{seed + epoch}:row", F.col(id_)), F.lit(":"), F.col(id_).cast("string"))), "__key", "position").drop("__key")
    return length_batches(placed, "position", length, batch, multiplier).withColumn("batch_order", draw(f"{seed + epoch}:batch", F.col("batch_id")))


def answer_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant's next: conv_id, turn, prompt, answer, system."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    system = F.max(F.when(F.col("role") == "system", F.struct("turn", "text"))).over(Window.partitionBy("conv_id"))["text"]
    next_ = turns.withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w)).withColumn("system", system)
    return next_.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "answer", "system")
