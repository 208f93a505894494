"""Mixing sources to target weights of tokens, small sources repeated up to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def plain_source(c: Column) -> Column:
    """A source as the targets spell it: lower case, no outer blanks, hyphens for underscores and inner blanks."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))), "[_ ]", "-")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: target_share, max_repeats, docs, tokens, rate.

    rate is the mean number of times a document of the source is used, at most max_repeats. Without
    total_tokens the mix is as large as it can be with every source that has documents at its share. Sources
    without documents get a null rate. A repeated source in targets has its shares added and its largest cap.
    """
    wanted = targets.filter("source is not null and target_share > 0").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats")
    )
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    # Both sides have a row per source; the targets fix which.
    t = wanted.join(F.broadcast(have.join(F.broadcast(wanted.select("source")), "source", "left_semi")), "source", "left")
    most = F.col("tokens") * F.col("max_repeats") / F.col("target_share")
    total = F.lit(float(total_tokens)) if total_tokens else F.col("_total")
    if not total_tokens:
        t = t.crossJoin(F.broadcast(t.filter("tokens > 0 and max_repeats > 0").agg(F.min(most).alias("_total"))))  # one row
    rate = F.least(total * F.col("target_share") / F.col("tokens"), F.col("max_repeats").cast("double"))
    return t.select("source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(F.col("tokens") > 0, rate).alias("rate"))


def mix(sizes: DataFrame, rate: DataFrame, seed: int = 20) -> DataFrame:
    """id, source, copy (from 1), tokens: each document floor(rate) times, and once more with probability of the fraction.

    sizes: id, source, tokens. The draw is a hash of (id, seed), so it doesn't depend on partitioning and a
    re-run task draws alike. Documents without tokens or of other sources aren't used.
    """
    used = sizes.filter("tokens > 0").join(F.broadcast(rate.filter("rate > 0").select("source", "rate")), "source")  # a row per target source
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    copies = (whole + (draw < F.col("rate") - whole).cast("long")).cast("int")
    return used.withColumn("copies", copies).filter("copies > 0").select("id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens")


def shares(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """Per target source: what was asked for and what the mix has. Shares are of all tokens of the mix; 0 for a source without documents."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("mixed_docs"), F.max("copy").alias("most_repeats"))
    joined = rate.join(F.broadcast(got), "source", "left")  # a row per target source
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    return joined.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), "rate", "max_repeats",
        "docs", "tokens", F.coalesce("mixed_docs", F.lit(0)).alias("mixed_docs"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )


def sized(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """id, source (plain spelling), tokens of each document, stored once for all later passes."""
    from . import tokens

    t = tokens.with_tokens(documents, "doc_id", "text", "source", folder=folder or tokens.FOLDER)
    return stored(t.select(F.col("doc_id").alias("id"), plain_source(F.col("source")).alias("source"), "tokens"), "sizes")
