"""Conversation logs: history texts, compaction, budgets, costs. Groups are single
conversations; turns are ordered by `turn`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.scalars import token_estimate
from tablesmith.operators import ranks

MOST_TOKENS = 2000
MESSAGE_TOKENS = 4
#: Begins the turn that stands for those that `snip` left out.
SNIPPED = "[snipped]"
STOP_SHARE, SMALL_GAIN, SMALL_GAINS = 0.9, 100, 5


def history(df: DataFrame, last: int | None = None) -> DataFrame:
    """`[role] text` of all turns but the system's, joined by blank lines; the last n if given."""
    rows = F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("t")))))
    rows = rows if last is None else F.slice(rows, F.greatest(F.lit(1), F.size(rows) - last + 1), F.lit(last))
    return df.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x.t), "\n\n").alias("history"))


def microcompact(df: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Texts over `most` tokens give way to a note with their number."""
    tokens = token_estimate(F.col("text"))
    return df.withColumn("tokens", tokens).withColumn("text", F.when(tokens > most, F.concat(F.lit("[compacted: "), tokens.cast("string"), F.lit(" tokens]"))).otherwise(F.col("text")))


def snip(df: DataFrame, boundary: float = 0.5) -> DataFrame:
    """The latest share of each conversation, one turn at least; system turns stay,
    and so do conversations of two turns. Where turns are cut off, a system turn in
    the place of the last of them says how many."""
    if boundary >= 1:
        return df
    by = Window.partitionBy("conv_id")
    other = F.col("role") != "system"
    size = F.count(F.when(other, 1)).over(by)
    nth = F.row_number().over(Window.partitionBy("conv_id", other).orderBy(F.col("turn").desc()))
    keep = F.greatest(F.lit(1), F.floor(size * boundary))
    rows = df.withColumn("_all", F.count("*").over(by)).withColumn("_last", other & (nth == keep + 1)).withColumn("_gone", size - keep).withColumn("_keep", ~other | (nth <= keep)).where("_keep or _all <= 2 or _last")
    mark = (F.col("_all") > 2) & F.col("_last")
    rows = rows.withColumn("role", F.when(mark, "system").otherwise(F.col("role"))).withColumn("text", F.when(mark, F.concat(F.lit(SNIPPED), F.lit(" "), F.col("_gone").cast("string"), F.lit(" earlier turns left out"))).otherwise(F.col("text")))
    return rows.drop("_all", "_last", "_gone", "_keep")


def budget(df: DataFrame, limit: int, share: float = STOP_SHARE, gain: int = SMALL_GAIN, gains: int = SMALL_GAINS) -> DataFrame:
    """Adds used (running tokens) and flag: budget_exceeded, or diminishing after
    so many turns in a row that each add little, else ok."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    tokens = token_estimate(F.col("text")) + MESSAGE_TOKENS
    rows = df.withColumn("tokens", tokens).withColumn("used", F.sum("tokens").over(order))
    small = F.min((F.col("tokens") < gain).cast("int")).over(order.rowsBetween(1 - gains, 0)) == 1
    enough = F.row_number().over(order) >= gains
    return rows.withColumn("flag", F.when(F.col("used") >= F.lit(int(share * limit)), "budget_exceeded").when(small & enough, "diminishing").otherwise("ok"))


def cost_rollup(df: DataFrame, prices: DataFrame, default: float) -> DataFrame:
    """Tokens and cost by model. A price belongs to the longest name that the
    model's name begins with; prices: (name, price), met by equal prefixes."""
    models = df.groupBy("model").agg(F.sum("tokens").alias("tokens"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("model")), lambda n: F.substring(F.col("model"), F.lit(1), n))
    met = models.withColumn("name", F.explode(F.coalesce(prefixes, F.array(F.lit(None).cast("string"))))).join(prices, "name", "left")
    best = met.groupBy("model", "tokens").agg(F.max_by("price", F.when(F.col("price").isNotNull(), F.length("name"))).alias("price"))
    return best.select("model", "tokens", (F.col("tokens") * F.coalesce("price", F.lit(default)) / 1e6).alias("cost"))


def paged(df: DataFrame, order: str, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """Newest first; a page has `most` rows at most."""
    return ranks.page(df, [(F.col(order), False)], max(offset, 0), min(limit, most))


