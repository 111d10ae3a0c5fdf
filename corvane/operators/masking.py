"""Parts of masking as DataFrame operations: lexicon words, rates, padding. Masked samples are made in :mod:`corvane.operators.masked`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.matching import CELL_BITS, cells

# Tokens whose words are never masked offline.
PROTECTED = ("ve", "veya", "ile", "bir", "bu", "şu", "o", "ki", "da", "de", "ama", "fakat", "için", "gibi", "çünkü", ".", ",", ":", ";", "!", "?", "(", ")", "[", "]", "{", "}", "-", "/", "\\", "'", '"', "`", "’", "“", "”", "…", "«", "»")
# A phrase's priority; least density of lexicon words, mask rate and their share of it, the last pair for any density; chances of the mask and of a random id; the online rate and its share of lexicon words.
PHRASE_PRIORITY = 5.0
DENSITY_TIERS = ((0.30, 0.25, 0.75), (0.15, 0.20, 0.65), (0.05, 0.18, 0.55))
FLOORS = (0.12, 0.35)
OUTCOME, LEGAL_OUTCOME = (0.80, 0.10), (0.90, 0.05)
ONLINE_RATE, BIAS = 0.15, 0.70


def word_map(tokens: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, word_id, priority, is_phrase`` of words that ``hits(key, term, priority, s, e)`` touch.

    A hit gives its priority to the word at its middle character. A hit of
    several words that covers at least two makes all words between the first
    and the last part of a phrase.
    """
    middle = F.floor((2 * F.col("s") + F.length("term")) / 2)
    placed = tokens.select(key, "start_at", "end_at", "word_id", F.explode(cells(F.col("start_at"), F.col("end_at"))).alias("cell"))
    at = hits.select(key, "priority", middle.alias("mid"), F.shiftright(middle, CELL_BITS).alias("cell")).join(placed, [key, "cell"]).where("start_at <= mid and mid < end_at")
    single = at.groupBy(key, "word_id").agg(F.max("priority").alias("priority"))
    several = hits.where(F.contains("term", F.lit(" "))).select(key, "term", "s", "e", F.explode(cells(F.col("s"), F.col("e"))).alias("cell"))
    spans = several.join(placed, [key, "cell"]).where("start_at < e and end_at > s").groupBy(key, "term", "s").agg(F.min("word_id").alias("lo"), F.max("word_id").alias("hi"))
    phrase = spans.where("lo < hi").select(key, F.explode(F.sequence("lo", "hi")).alias("word_id")).distinct().withColumn("is_phrase", F.lit(True))
    both = single.join(phrase, [key, "word_id"], "full_outer")
    return both.select(key, "word_id", F.when(F.col("is_phrase"), PHRASE_PRIORITY).otherwise(F.col("priority")).alias("priority"), F.coalesce("is_phrase", F.lit(False)).alias("is_phrase"))


def rates(density: Column) -> tuple[Column, Column]:
    """Mask rate and legal share by the density of legal words."""
    rate, share = (F.lit(x) for x in FLOORS)
    for limit, r, s in reversed(DENSITY_TIERS):
        rate, share = F.when(density > limit, r).otherwise(rate), F.when(density > limit, s).otherwise(share)
    return F.least(F.greatest(rate, F.lit(0.12)), F.lit(0.28)).cast("double"), F.least(F.greatest(share, F.lit(0.35)), F.lit(0.80)).cast("double")


def pad(ids: Column, size: Column, filler: int) -> Column:
    """``ids`` filled up to ``size`` on the right."""
    return F.concat(ids, F.array_repeat(F.lit(filler), (size - F.size(ids)).cast("int")))
