"""Generated conversations: the same seed gives the same rows, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ASKS = ("where is my order", "i want to return it", "please change my address", "i was charged twice")
_ANSWERS = ("i will look that up", "i have opened a return", "i have changed it", "the charge goes back today")


def card_number(digits: Column) -> Column:
    """15 digits completed by the one that makes the Luhn sum a multiple of ten."""
    d = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substring(digits, i, F.lit(1)).cast("int"))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    total = F.aggregate(twice, F.lit(0), lambda a, x: a + x)
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def conversations(spark: SparkSession, count: int, seed: int, pii: float = 0.2, limit: int | None = None) -> DataFrame:
    """record_id, turn, speaker, text: `count` records of three turns, or `limit` if it is given; a share `pii` of them tells a card number."""
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(n))
    d = spark.range(count if limit is None else limit)
    k = draw("topic", len(_ASKS)).cast("int")
    card = card_number(F.concat(F.lit("4"), F.lpad(draw("card", 10**14).cast("string"), 14, "0")))
    told = draw("pii", 1_000_000) < int(pii * 1_000_000)
    turns = F.array(F.struct(F.lit("human_agent").alias("speaker"), F.lit("how can i help").alias("text")),
                    F.struct(F.lit("caller").alias("speaker"), F.concat(F.get(F.lit(list(_ASKS)), k), F.when(told, F.concat(F.lit(", my card is "), card)).otherwise("")).alias("text")),
                    F.struct(F.lit("human_agent").alias("speaker"), F.get(F.lit(list(_ANSWERS)), k).alias("text")))
    return d.select(F.format_string(f"gen-{seed}-%06d", "id").alias("record_id"), F.posexplode(turns).alias("turn", "t")).select("record_id", "turn", "t.speaker", "t.text")
