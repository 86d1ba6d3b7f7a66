"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn costs its words and a fixed overhead. Prefix sums of these costs cut a
conversation into turn-aligned spans: with `room` = budget - cost of the system
turn and `step` = room / 2, a turn that begins in [k * step, (k + 1) * step)
belongs to span k; a turn longer than `step` is always the last of its span and
becomes a span of its own. So a span costs less than `room` unless it is one
turn that does not fit, which is kept whole and marked `over_budget`.

Each span becomes a window: the system turn, then as many whole turns before the
span as fit into `history` and into what the budget leaves, then the span. Only
assistant turns of the span itself are under the loss mask, so each is there once.

A conversation's sums are taken in blocks of turn numbers and added up over the
blocks, and history meets windows by buckets of the prefix sum, so a
conversation that holds a large part of all rows is not one task's work.

The template: `<|turn|>role<|text|>text<|end|>` for each turn. Inside roles and
texts a backslash is doubled, and one is put behind the first character of each
control string, so no text can hold one; `unescape` takes both back.

Defined results: null role or text is empty. Turns are ordered by number (null
first), then role, then text; repeated rows are repeated turns. Rows without a
conversation id are one conversation. A system turn counts as such only as a
conversation's first turn with others behind it. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from newsloom.session import cut

BUDGET, HISTORY, OVERHEAD = 1024, 256, 4
BLOCK = 64                # turn numbers of a block
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_REST = r"(?=\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])" + _REST, r"$1\\")


def unescape(text: Column) -> Column:
    single = F.regexp_replace(text, r"([<\[])\\" + _REST, "$1")
    return F.replace(single, F.lit("\\\\"), F.lit("\\"))


def costed(turns: DataFrame, budget: int = BUDGET, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its position, cost, prefix sum `at` (system turn left
    out), the conversation's system turn, its room and the span it belongs to."""
    words = F.regexp_count(F.col("text"), F.lit(r"\S+")).cast("long") + OVERHEAD
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 61))).cast("long")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("cost", words).withColumn("block", block)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = cut(rows.withColumn("nth", F.row_number().over(inside)).withColumn(
        "sum", F.sum("cost").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cost")))
    head = F.max(F.when(F.col("nth") == 1, F.struct("role", "text", "cost"))).alias("head")
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("cost").alias("c"), head)
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    of_conv = Window.partitionBy("conv_id")
    blocks = blocks.select(
        F.col("conv_id").alias("c_id"), F.col("block").alias("c_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_before"),
        first.alias("first"), F.sum("n").over(of_conv).alias("n_turns"))
    system = F.when((F.col("first.role") == "system") & (F.col("n_turns") > 1), F.col("first"))
    blocks = blocks.select("c_id", "c_block", "n_before", "c_before", system.alias("system"))
    joined = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("block") == F.col("c_block")))
    reserved = F.coalesce(F.col("system.cost"), F.lit(0))
    rows = joined.select(
        "conv_id", "role", "text", "cost", "system", (F.col("n_before") + F.col("nth") - 1).alias("position"),
        (F.col("c_before") + F.col("sum") - reserved).alias("at"), (F.lit(budget) - reserved).alias("room"))
    step = F.greatest(F.lit(1), F.floor(F.col("room") / 2))
    return rows.withColumn("is_system", F.col("system").isNotNull() & (F.col("position") == 0)).withColumn(
        "span", F.floor(F.col("at") / step) * 2 + (F.col("cost") > step).cast("long"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, **columns) -> DataFrame:
    """One row a window: conv_id, span (orders a conversation's windows),
    formatted, n_turns, n_context (turns at the front that are repeated),
    loss_starts and loss_ends (code points), cost, over_budget."""
    rows = cut(costed(turns, budget, **columns))
    body = rows.filter("not is_system")
    spans = body.groupBy("conv_id", "span").agg(
        F.min("at").alias("begin"), F.sum("cost").alias("cost"), F.max("room").alias("room"), F.max("system").alias("system"))
    reach = F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - F.col("cost"), F.col("begin")))
    spans = cut(spans.withColumn("reach", reach))
    own = body.select("conv_id", "span", "at", "role", "text", F.lit(True).alias("new"))
    # the system turn is new in a conversation's first window and repeated in the others
    system = spans.filter("system is not null").select(
        "conv_id", "span", F.lit(-1).cast("long").alias("at"), F.col("system.role").alias("role"), F.col("system.text").alias("text"),
        (F.col("begin") == 0).alias("new"))
    width = max(1, history)
    bucket = lambda x: F.floor(x / width)
    asked = spans.filter("reach > 0").select(
        F.col("conv_id").alias("w_conv"), F.col("span").alias("w_span"), "begin", "reach",
        F.explode(F.sequence(bucket(F.col("begin") - F.col("reach")), bucket(F.col("begin") - 1))).alias("w_bucket"))
    earlier = body.withColumn("bucket", bucket(F.col("at"))).join(
        asked, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("bucket") == F.col("w_bucket"))
        & (F.col("at") >= F.col("begin") - F.col("reach")) & (F.col("at") < F.col("begin")))
    repeated = earlier.select("conv_id", F.col("w_span").alias("span"), "at", "role", "text", F.lit(False).alias("new"))
    gathered = own.unionByName(system).unionByName(repeated).groupBy("conv_id", "span").agg(
        F.sort_array(F.collect_list(F.struct("at", "new", F.col("role").alias("plain_role"), escape(F.col("role")).alias("role"),
                                             escape(F.col("text")).alias("text")))).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"), F.expr("cast(array() as array<int>)").alias("ends"))

    def place(state: Column, t: Column) -> Column:
        begin = state["at"] + F.char_length(head(t))
        end = begin + F.char_length(t["text"])
        under = t["new"] & (t["plain_role"] == "assistant")
        more = lambda a, x: F.when(under, F.concat(a, F.array(x))).otherwise(a)
        return F.struct((end + len(END)).alias("at"), more(state["starts"], begin).alias("starts"), more(state["ends"], end).alias("ends"))

    loss = F.aggregate("turns", empty, place)
    out = gathered.select("conv_id", "span", formatted.alias("formatted"), F.size("turns").alias("n_turns"),
                          F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_context"), loss.alias("loss"),
                          F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.regexp_count(t["text"], F.lit(r"\S+")) + OVERHEAD).alias("cost"))
    return out.select("conv_id", "span", "formatted", "n_turns", "n_context", F.col("loss.starts").alias("loss_starts"),
                      F.col("loss.ends").alias("loss_ends"), "cost", (F.col("cost") > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from windows alone: its turns and the text under the
    loss mask, each as one string, with their counts."""
    pieces = F.split(F.col("formatted"), r"<\|end\|>", -1)
    new = F.slice(pieces, F.col("n_context") + 1, F.col("n_turns") - F.col("n_context"))
    role = lambda p: unescape(F.substring_index(p, TEXT, 1).substr(F.lit(len(TURN) + 1), F.char_length(p)))
    text = lambda p: unescape(p.substr(F.char_length(F.substring_index(p, TEXT, 1)) + len(TEXT) + 1, F.char_length(p)))
    turns = F.array_join(F.transform(new, lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n"))), "")
    spans = F.arrays_zip(F.col("loss_starts").alias("a"), F.col("loss_ends").alias("b"))
    loss = F.array_join(F.transform(spans, lambda s: unescape(F.col("formatted").substr(s["a"] + 1, s["b"] - s["a"]))), "")
    one = formatted.select("conv_id", F.struct("span", turns.alias("turns"), loss.alias("loss")).alias("w"),
                           (F.col("n_turns") - F.col("n_context")).cast("long").alias("n"), F.char_length("formatted").cast("long").alias("chars"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"),
                                       F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("w", lambda x: x["turns"]), "").alias("turns"),
                        F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"), "formatted_chars", "n_windows")
