"""Records of several sources combined so that each source has its target share of all tokens.

Method: tokens are summed per source; a source's rate is share * total / tokens, at most its cap of uses; each record is
emitted floor(rate) times and once more if a hash of its id and the seed, read as a number in [0, 1), is below the rate's
fraction. The total is a parameter; by default it is the largest for which every source that has tokens reaches its share
within its cap. Rates are a table of one row per source of the targets. Its size is checked: if small it is broadcast and
records meet it in a narrow pass, so a source with most of the records is no hot key; else the join is left to Spark.

Spelling: source names are trimmed, lower-cased, and blanks and hyphens read as underscores.

Defined results: records of a null source or one without target are not used, and the report has them with target 0; a
target without tokens gets none and is reported with share 0; texts without tokens may be emitted but weigh nothing; null
ids hash as null; repeated target rows: the largest share counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.llm.tokens import RANKS, with_token_counts
from cladeworks.scratch import small, stage


def normal_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def source_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = RANKS) -> DataFrame:
    """``id, source, n_tokens``, written once."""
    src = docs.select(id_col, text_col, normal_source(F.col(source_col)).alias("mix_source"))
    return stage(with_token_counts(src, id_col, text_col, "mix_source", path=path).select("id", F.col("mix_source").alias("source"), "n_tokens"), "mix")


def rates(tokens: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``source, target_share, max_repeats, available, rate`` for each target, written once."""
    t = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy(normal_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = tokens.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("available"))
    rows = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0.0)))
    if total is None:
        reach = F.when(F.col("available") > 0, F.col("max_repeats") * F.col("available") / F.col("target_share"))
        whole = rows.agg(F.coalesce(F.min(reach), F.lit(0.0))).scalar()
    else:
        whole = F.lit(float(total))
    rate = F.when(F.col("available") > 0, F.least(F.col("target_share") * F.col("whole") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return stage(rows.withColumn("whole", whole).select("source", "target_share", "max_repeats", "available", rate.alias("rate")), "rates")


def mix(tokens: DataFrame, rate_table: DataFrame, seed: int = 42) -> DataFrame:
    """``id, source, copy, n_tokens``: every emitted copy."""
    # 53 bits of the hash, exact in a double
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") / F.lit(float(2**53))
    x = tokens.join(small(rate_table.select("source", "rate")), "source")
    n = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    x = x.withColumn("copies", n).filter("copies > 0")
    return x.select("id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens")


def reached(mixed: DataFrame, tokens: DataFrame, rate_table: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, rate, n_records, n_copies, n_tokens, share``: what each source really got."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_copies"), F.sum("n_tokens").alias("got"))
    have = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("have"))
    x = rate_table.join(have, "source", "full").join(got, "source", "left")
    zero = F.lit(0).cast("bigint")
    whole = F.sum("got").over(Window.partitionBy())  # over one row per source
    return x.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("rate", F.lit(0.0)).alias("rate"),
        F.coalesce("n_records", zero).alias("n_records"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("got", zero).alias("n_tokens"),
        F.coalesce(F.col("got") / whole, F.lit(0.0)).alias("share"),
    )
