"""Building a lexicon of terms and their priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# The terms every lexicon gets, and the stems that raise a term's priority.
SEED_TERMS = (
    "Yargıtay", "Danıştay", "Anayasa Mahkemesi", "Bölge Adliye Mahkemesi", "Cumhuriyet Başsavcılığı", "Ağır Ceza Mahkemesi", "Asliye Ceza Mahkemesi", "Sulh Ceza Hakimliği",
    "İcra Hukuk Mahkemesi", "Asliye Hukuk Mahkemesi", "İddianame", "Kovuşturma", "Soruşturma", "Beraat", "Mahkumiyet", "Hükmün Açıklanmasının Geri Bırakılması", "Takipsizlik",
    "İstinaf", "Temyiz", "Karar Düzeltme", "Kanun Yararına Bozma", "Müdafii", "Sanık", "Mağdur", "Müşteki", "Katılan", "Tanık", "Bilirkişi", "Keşif", "Duruşma", "Gerekçeli Karar",
    "Kıdem Tazminatı", "İhbar Tazminatı", "Kötüniyet Tazminatı", "Maddi Tazminat", "Manevi Tazminat", "Boşanma", "Velayet", "Nafaka", "Mal Rejimi", "Miras", "Vasiyetname",
    "Tapu İptali ve Tescil", "Men'i Müdahale", "Ecrimisil", "Kamulaştırma", "Ortaklığın Giderilmesi", "İhtiyati Tedbir", "İhtiyati Haciz", "İcra Takibi", "Ödeme Emri", "Haciz",
    "Yakalama", "Gözaltı", "Tutuklama", "Tahliye", "Adli Kontrol", "Uzlaşma", "Önödeme", "Tekerrür", "Haksız Tahrik", "Meşru Müdafaa", "İştirak", "Teşebbüs", "Gönüllü Vazgeçme",
    "Etkin Pişmanlık", "Zincirleme Suç", "Fikri İçtima",
)
STATUTE_STEMS = ("kanun", "madde", "fıkra", "bend")
PENAL_STEMS = ("ceza", "suç", "tazminat", "hapis")


def build(lines: DataFrame, seed: tuple[str, ...] = SEED_TERMS, unicode: bool = True) -> DataFrame:
    """``term`` from ``lines(value)``: short lines whole, lines of ten words or more split; distinct, with the seed terms."""
    line = T.strip(F.col("value"))
    line = T.nfkc(line) if unicode else line
    rows = lines.where(T.strip(F.col("value")) != "").select(line.alias("line"))  # NFKC empties no line
    short = T.word_count(F.col("line")) < 10
    parts = F.when(short, F.array("line")).otherwise(T.split_terms(F.col("line")))
    # parts of a line in NFKC are in NFKC, so terms need no second pass through Python
    terms = rows.select(F.explode(parts).alias("part"), F.when(short, 2).otherwise(3).alias("least"))
    terms = terms.select(T.normalize_term(F.col("part"), False).alias("term"), "least").where("length(term) >= least").select("term")
    return terms.union(lines.sparkSession.createDataFrame([(t,) for t in seed], "term string")).distinct() if seed else terms.distinct()


def ordered(terms: DataFrame) -> DataFrame:
    """Longest first, ties by name."""
    return terms.orderBy(F.desc(F.length("term")), "term")


def priority(norm):
    """1, for several words 1.5; stems of penal law 1.8 and of statutes 2 come before that."""
    p = F.when(T.word_count(norm) > 1, 1.5).otherwise(1.0)
    for stems, value in ((PENAL_STEMS, 1.8), (STATUTE_STEMS, 2.0)):
        hit = F.lit(False)
        for s in stems:
            hit = hit | F.contains(norm, F.lit(s))
        p = F.when(hit, value).otherwise(p)
    return p.cast("double")


def prioritised(terms: DataFrame, unicode: bool = True) -> DataFrame:
    """``idx, term, norm, n_words, priority`` of ``terms(idx, term)``; of terms that fold alike the last stays."""
    rows = terms.select("idx", "term", T.search_fold(F.col("term"), unicode).alias("norm"))
    rows = rows.groupBy("norm").agg(F.max(F.struct("idx", "term")).alias("last"))
    return rows.select("last.idx", "last.term", "norm", T.word_count(F.col("norm")).alias("n_words"), priority(F.col("norm")).alias("priority"))
