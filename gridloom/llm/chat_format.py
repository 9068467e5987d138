"""Chat formatting: every assistant turn becomes an example whose context is all turns before it.

A turn is written `<turn>role`, a line break, the text, `</turn>`, a line break. Inside roles and
texts `\\` becomes `\\b`, `<` becomes `\\l` and, in roles, a line break becomes `\\n`; so no mark can
occur inside, and undoing the three in reverse order restores the text. Only the reply of the
example's own turn is under the loss mask, given as the span [loss_start, loss_stop) of code
points. A conversation that ends in other turns gets one more example without loss, so that no
turn is lost. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def examples(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conv_id, example (0, 1, ...), n_context, formatted, loss_start, loss_stop, is_last.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one
    order; null roles and texts are empty; rows of null conv_id make one conversation; other
    columns are not read; an empty table gives none. The turns of one conversation meet in
    one task, as its examples each hold a prefix of it; a conversation above 2 GB, the most that a row of
    Spark holds, fails the job rather than being cut.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = grouped.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))).alias("marked"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("lengths"),
        F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == trainable, i)), lambda i: i.isNotNull()).alias("own"),
    )
    # The last turn is the target of the last example, or a tail without loss follows.
    last = F.size("marked") - 1
    ends = F.when(F.array_contains("own", last), F.col("own")).otherwise(F.concat("own", F.array(last)))
    each = marked.select("conv_id", "marked", "lengths", "own", last.alias("last"), F.posexplode(ends).alias("example", "target"))
    each = each.select("conv_id", "example", F.col("target").alias("n_context"), F.array_join(F.slice("marked", F.lit(1), F.col("target") + 1), "").alias("formatted"), F.array_contains("own", F.col("target")).alias("trains"), F.element_at("lengths", F.col("target") + 1).alias("n"), (F.col("target") == F.col("last")).alias("is_last"))
    stop = F.length("formatted") - len(CLOSE)
    return each.select("conv_id", "example", "n_context", "formatted", F.when(F.col("trains"), stop - F.col("n")).alias("loss_start"), F.when(F.col("trains"), stop).alias("loss_stop"), "is_last")


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted example."""
    marked = F.split(formatted, "</turn>\n", -1)
    inner = F.transform(F.slice(marked, F.lit(1), F.size(marked) - 1), lambda m: F.substring(m, F.lit(len(OPEN) + 1), F.length(m)))
    return F.transform(inner, lambda m: F.struct(unescape_role(F.substring_index(m, "\n", 1)).alias("role"), unescape(F.substring(m, F.length(F.substring_index(m, "\n", 1)) + 2, F.length(m))).alias("text")))


def loss_text(formatted: Column, start: Column, stop: Column) -> Column:
    """What is under the loss mask, unescaped; null where nothing is."""
    return unescape(F.substring(formatted, start + 1, stop - start))


def digest(formatted_examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns and loss text as counts and SHA-256 sums.

    A conversation without a reply has an empty loss text; null conv_ids make one; further columns are not read; no
    examples give no rows. A conversation's replies meet in one row, which Spark limits to 2 GB, as examples() does.
    """
    turns = parse(F.col("formatted"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted_examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.size(turns)).cast("long").alias("n"),
        F.when(F.col("is_last"), F.sha2(whole, 256)).alias("sha"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_stop")).alias("loss"),
    )
    one = rows.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("replies"), F.sum("chars").alias("formatted_chars"))
    joined = F.array_join(F.transform("replies", lambda r: r["loss"]), "")
    return one.select("conv_id", "n_turns", "turns_sha256", F.length(joined).cast("long").alias("loss_chars"), F.sha2(joined, 256).alias("loss_sha256"), "formatted_chars")
