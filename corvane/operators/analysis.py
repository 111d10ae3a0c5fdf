"""Statistics over masked samples and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.acquisition import is_corrupt
from corvane.operators.matching import overlapping
from corvane.operators.skew import checked_broadcast

IGNORED = -100


def outcomes(ids: str, labels: str, mask_id: int) -> dict[str, Column]:
    """Counts of unmasked, masked, kept and replaced positions of a sample."""
    pairs = F.arrays_zip(F.col(ids).alias("i"), F.col(labels).alias("l"))
    kinds = F.transform(pairs, lambda x: F.when(x["l"] == IGNORED, 0).when(x["l"].isNull(), None).when(x["i"] == mask_id, 1).when(x["i"] == x["l"], 2).when(x["i"] != x["l"], 3))
    return {name: F.size(kinds) - F.size(F.array_remove(kinds, kind)) for kind, name in enumerate(("unmasked", "masked", "kept", "replaced"))}  # one pass, which Spark shares


def reconstruct(tokens: DataFrame, key: str = "sample_id") -> DataFrame:
    """Words of labelled islands of ``tokens(key, pos, token, label)``: a word starts at a marked token, or without start at an island's unmarked first; blank words are dropped."""
    w = Window.partitionBy(key).orderBy("pos")
    labelled = F.col("label") != IGNORED
    marked = F.col("token").startswith("▁")
    begins = labelled & (marked | ~F.coalesce(F.lag(labelled).over(w), F.lit(False)))
    rows = tokens.withColumn("marked", marked).withColumn("word_no", F.sum(begins.cast("int")).over(w)).where(labelled)
    words = rows.groupBy(key, "word_no").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "marked"))).alias("t"))
    text = F.trim(F.replace(F.array_join(F.transform("t", lambda x: x["token"]), ""), F.lit("▁"), F.lit(" ")))
    first, last = F.element_at("t", 1), F.element_at("t", -1)
    return words.select(key, "word_no", text.alias("word"), F.when(first["marked"], first["pos"]).alias("start"), last["pos"].alias("end"), F.size("t").alias("n_tokens")).where("word != ''")


def classify(words: DataFrame, terms: DataFrame, word: str = "word") -> DataFrame:
    """``class`` of each word by ``terms(term)``, lower case: single, phrase, partial or none.

    The lexicon's joins run on distinct words, so the one that looks for terms
    inside words does not grow with repeated words.
    """
    lower = F.lower(F.col(word))
    distinct = words.select(lower.alias("w")).distinct()
    known = terms.select("term", F.contains("term", F.lit(" ")).alias("several"))
    exact = known.select(F.col("term").alias("w"), "several")
    parts = known.where("several").select(F.explode(F.split("term", " ")).alias("w")).distinct().withColumn("in_phrase", F.lit(True))
    longer = known.where("length(term) > 4").select("term")
    inside = overlapping(distinct, longer.withColumn("priority", F.lit(1.0)), "w", "w").select("w").distinct().withColumn("has_term", F.lit(True))
    named = distinct.join(exact, "w", "left").join(parts, "w", "left").join(inside, "w", "left")
    kind = F.when(~F.col("several"), "single").when(F.col("several"), "phrase").when(F.col("in_phrase") | F.col("has_term"), "partial").otherwise("none")
    named = named.select("w", kind.alias("class"))
    return words.withColumn("w", lower).join(named, "w").drop("w")


def consecutive(words: DataFrame, phrases: DataFrame, key: str = "sample_id", order: str = "place", word: str = "word") -> DataFrame:
    """Where the words of ``phrases(phrase)`` follow each other in a sample's list of words."""
    sizes = sorted(r["n"] for r in phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect())  # phrase lengths, a handful
    w = Window.partitionBy(key).orderBy(order)
    out = None
    for n in sizes:
        grams = words.select(key, F.col(order).alias("start"), F.concat_ws(" ", *[F.lead(F.lower(F.col(word)), i).over(w) for i in range(n)]).alias("gram"), F.lead(F.lit(1), n - 1).over(w).alias("whole")).where("whole = 1")
        found = grams.join(F.broadcast(phrases.where(F.size(F.split("phrase", " ")) == n)) if phrases.limit(100_001).count() <= 100_000 else phrases, F.col("gram") == F.col("phrase")).select(key, "start", (F.col("start") + n - 1).alias("end"), "phrase")
        out = found if out is None else out.union(found)
    return out


def shares(counts: dict[str, Column]) -> dict[str, Column]:
    """Percentages of masked, kept and replaced positions among the labelled ones; null where there are none."""
    labelled = counts["masked"] + counts["kept"] + counts["replaced"]
    return {f"{k}_share": F.when(labelled > 0, 100.0 * counts[k] / labelled) for k in ("masked", "kept", "replaced")}


def named(samples: DataFrame, vocabulary: DataFrame, key: str = "sample_id") -> DataFrame:
    """``key, pos, token, label, original`` of ``samples(key, input_ids, labels)``: ids by ``vocabulary(id, token)``; -100 looks up id 0; ids without a token have null."""
    at = F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "x")
    rows = samples.select(key, at).select(key, "pos", F.col("x.input_ids").alias("id"), F.col("x.labels").alias("label"))
    rows = rows.withColumn("of", F.when(F.col("label") == IGNORED, 0).otherwise(F.col("label")))
    few = checked_broadcast(vocabulary.select("id", "token"))
    rows = rows.join(few, "id", "left")
    return rows.join(few.select(F.col("id").alias("of"), F.col("token").alias("original")), "of", "left").select(key, "pos", "token", "label", "original")


def progress(rows: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Saved and corrupt rows of every group, and of all in a row with a null group."""
    bad = is_corrupt(F.col(text))
    return rows.rollup(by).agg(F.count_if(~bad).alias("saved"), F.count_if(bad).alias("corrupted"), F.count(F.lit(1)).alias("total"))


def table_text(rows: DataFrame, title: str) -> str:
    """A small table as aligned text under a title: a report for people. All rows are shown, so pass aggregates."""
    names = rows.columns
    cells = [names, *([("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in rows.collect())]
    wide = [max(len(r[i]) for r in cells) for i in range(len(names))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in cells]
    return "\n".join([title, "=" * len(title), *lines])


def ratio_bin(ratio: Column) -> Column:
    """Fifths of [0, 1); 1 is in none."""
    c = F.lit(None).cast("int")
    for i in range(5):
        c = F.when((ratio >= i / 5) & (ratio < (i + 1) / 5), i).otherwise(c)
    return c


def perplexity(loss: Column) -> Column:
    return F.when(loss < 100, F.exp(loss)).otherwise(F.lit(float("inf")))


def steps(samples: int, batch: int, accumulate: int, epochs: int, warm: float = 0.1) -> tuple[int, int]:
    """Optimiser steps and warm-up steps."""
    per_epoch = -(-(-(-samples // batch)) // accumulate)
    return per_epoch * epochs, int(per_epoch * epochs * warm)
