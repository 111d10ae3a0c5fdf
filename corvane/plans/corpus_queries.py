"""Queries over lexicons, matching, masking, sampling, acquisition, analysis and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.keyed import uniform
from corvane.operators import acquisition, analysis, lexicon, masked, masking, matching, sampling, tokens, windows
from corvane.plans.fixtures import frame, values
from corvane.plans.text_queries import _N, _TOK, counts, docs
from corvane.sources import sinks
from corvane.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u(*keys: str) -> str:
    """The keyed uniform number in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::bigint / 4294967296.0::double)"


def u4(salt: str, number: str, key: str = "doc_id", chunk: str = "chunk") -> str:
    """The same for numbered things of a window, four to an MD5."""
    return f"(('0x' || substr(md5(concat_ws('|', '{salt}', {key}, {chunk}, ({number}) // 4)), 8 * (({number}) % 4)::int + 1, 8))::bigint / 4294967296.0::double)"


# ---- lexicon

_LINES = [("a b c d e f g h i, jj kkk; l",), ('"(Haciz);"',), ("  ",), ("x",), ("ceza",), ("ceza",)]
_BUILT = [("a b c d e f g h i",), ("jj kkk",), ("Haciz",), ("ceza",)]
_PRIO = [(0, "ceza"), (1, "ağır ceza"), (2, "ceza kanunu"), (3, "asliye mahkemesi"), (4, "sanık"), (5, "Sanık")]


@query("lexicon_build", f"select term from {values(_BUILT, 'term')}")
def lexicon_build(spark, sf_dir):
    return lexicon.build(frame(spark, _LINES, "value string"), seed=())


@query("lexicon_seeded", f"select count(*)::bigint n, max(length(term))::int longest from (select term from {values(_BUILT, 'term')} union select term from {values([(t,) for t in lexicon.SEED_TERMS], 'term')})")
def lexicon_seeded(spark, sf_dir):
    return lexicon.build(frame(spark, _LINES, "value string")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("term")).alias("longest"))


@query("lexicon_order", f"select term, (row_number() over (order by length(term) desc, term))::int place from {values([(t,) for t in lexicon.SEED_TERMS], 'term')}")
def lexicon_order(spark, sf_dir):
    from pyspark.sql.window import Window

    terms = frame(spark, [(t,) for t in lexicon.SEED_TERMS], "term string")  # one window: a lexicon is small
    return terms.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.length("term")), "term")))


@query("lexicon_priority", f"select idx::int idx, term, priority::double priority from {values([(0, 'ceza', 1.8), (1, 'ağır ceza', 1.8), (2, 'ceza kanunu', 2.0), (3, 'asliye mahkemesi', 1.5), (5, 'Sanık', 1.0)], 'idx', 'term', 'priority')}")
def lexicon_priority(spark, sf_dir):
    return lexicon.prioritised(frame(spark, _PRIO, "idx int, term string")).select("idx", "term", "priority")


# ---- matching; the lexicon is English so that documents match

TERMS = [(0, "the and", 1.5), (1, "with", 1.0), (2, "of the", 1.5), (3, "tion", 1.0), (4, "les", 1.0), (5, "in the", 1.5), (6, "and", 1.8), (7, "schein", 2.0)]
_FOLD = "(select doc_id, translate(lower(translate(text, 'İI', 'iı')), 'âîû', 'aiu') norm from documents)"
_TERMS = values(TERMS, "idx", "term", "priority")
# string_split gives the gaps between occurrences; no term of this lexicon overlaps itself
_HITS = f"""(select doc_id, term, priority, (e - length(term))::bigint s, e::bigint e from (
    select doc_id, term, priority, i, n, sum(length(gap) + length(term)) over (partition by doc_id, term order by i) e from (
    select doc_id, term, priority, unnest(g) gap, generate_subscripts(g, 1) i, len(g) n from (
    select doc_id, term, priority::double priority, string_split(norm, term) g from {_FOLD}, {_TERMS} where contains(norm, term)))) where i < n)"""


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.search_fold(F.col("text"), unicode=False).alias("norm"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.overlapping(folded(spark, sf_dir), frame(spark, TERMS, "idx int, term string, priority double").drop("idx"))


@query("match_all_overlaps", f"select doc_id, term, count(*) n, sum(s)::bigint starts, sum(e)::bigint ends from {_HITS} group by 1, 2")
def match_all_overlaps(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("starts"), F.sum("e").alias("ends"))


@query("match_self_overlap", "select * from (values ('aa', 0::bigint), ('aa', 1::bigint), ('aa', 4::bigint), ('a', 0::bigint), ('a', 1::bigint), ('a', 2::bigint), ('a', 4::bigint), ('a', 5::bigint)) t(term, s)")
def match_self_overlap(spark, sf_dir):
    return matching.overlapping(frame(spark, [(1, "aaabaa")], "doc_id int, norm string"), frame(spark, [("aa", 1.0), ("a", 1.0)], "term string, priority double")).select("term", "s")


_ALT = matching.alternation([t for _, t, _ in TERMS]).replace("\\ ", " ")
_SPANS = f"""(select doc_id, e - size s, e from (select doc_id, size, sum(gap + size) over (partition by doc_id order by i) e from (
    select doc_id, length(unnest(m)) size, length(unnest(g[:len(m)])) gap, generate_subscripts(m, 1) i from (
    select doc_id, regexp_extract_all(norm, '{_ALT}') m, regexp_split_to_array(norm, '{_ALT}') g from {_FOLD}))))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy(folded(spark, sf_dir), [t for _, t, _ in TERMS])


@query("match_greedy", f"select doc_id, count(*) n, sum(s)::bigint starts, sum(e)::bigint ends from {_SPANS} group by 1")
def match_greedy(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("starts"), F.sum("e").alias("ends"))


@query("match_greedy_fixture", "select 1::int doc_id, 0::bigint s, 2::bigint e")
def match_greedy_fixture(spark, sf_dir):
    return matching.greedy(frame(spark, [(1, "abcd")], "doc_id int, norm string"), ["ab", "bcd"]).select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


_LEGAL = f"(select t.doc_id, pos, word_id, token, bool_or(x.s is not null) legal from {_TOK} t left join {_SPANS} x on x.doc_id = t.doc_id and x.s <= (start_at + end_at) / 2.0 and (start_at + end_at) / 2.0 < x.e group by all)"


def legal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.tokens_in_spans(tokens.tokenize(docs(spark, sf_dir)), spans(spark, sf_dir))


@query("tokens_in_spans", f"select doc_id, count(*) n, count(*) filter (legal) legal, sum(case when legal then pos end)::bigint places from {_LEGAL} group by 1")
def tokens_in_spans(spark, sf_dir):
    return legal_tokens(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("legal").alias("legal"), F.sum(F.when(F.col("legal"), F.col("pos"))).cast("long").alias("places"))


_SINGLE = f"(select h.doc_id, word_id, max(priority) priority from {_HITS} h join {_TOK} t on t.doc_id = h.doc_id and start_at <= (2 * s + length(term)) // 2 and (2 * s + length(term)) // 2 < end_at group by all)"
_PHRASE = f"(select distinct doc_id, unnest(range(lo, hi + 1)) word_id from (select h.doc_id, term, s, min(word_id) lo, max(word_id) hi from {_HITS} h join {_TOK} t on t.doc_id = h.doc_id and start_at < e and end_at > s where contains(term, ' ') group by all) where lo < hi)"
_MAP = f"(select coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.word_id, b.word_id) word_id, case when b.doc_id is not null then 5.0::double else priority end priority, b.doc_id is not null is_phrase from {_SINGLE} a full join {_PHRASE} b on a.doc_id = b.doc_id and a.word_id = b.word_id)"


def word_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked.lexicon_words(docs(spark, sf_dir), lexicon_terms(spark))


@query("legal_word_map", f"select doc_id, count(*) n, sum(priority)::double total, count(*) filter (is_phrase) phrases, sum(word_id)::bigint words from {_MAP} group by 1")
def legal_word_map(spark, sf_dir):
    return word_map(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("total"), F.count_if("is_phrase").alias("phrases"), F.sum(F.col("word_id").cast("long")).alias("words"))


@query("phrase_ranges", f"select doc_id, count(*) n, sum(word_id)::bigint words from {_PHRASE} group by 1")
def phrase_ranges(spark, sf_dir):
    return word_map(spark, sf_dir).where("is_phrase").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("word_id").cast("long")).alias("words"))


# ---- offline masking

_CHUNKS = f"(select doc_id, (s / 256)::int chunk, s::int \"start\" from (select doc_id, n, unnest(generate_series(0, n - 1, 256)) s from {_N} where n > 0) where n - s >= 10)"
_PROT = "(" + ", ".join("'" + p.replace("'", "''") + "'" for p in masking.PROTECTED) + ")"
_CTOK = f"(select t.doc_id, c.chunk, t.pos - c.start pos, word_id, token from {_TOK} t join {_CHUNKS} c on t.doc_id = c.doc_id and t.pos >= c.start and t.pos < c.start + 510)"
_BUDGET = f"""
words as (select w.doc_id, chunk, w.word_id, first_pos, protected, priority, coalesce(is_phrase, false) is_phrase from
    (select doc_id, chunk, word_id, min(pos) first_pos, bool_or(token in {_PROT}) protected from {_CTOK} group by all) w left join {_MAP} m on m.doc_id = w.doc_id and m.word_id = w.word_id),
dens as (select *, (count(priority) over c)::double / count(*) over c density, count(*) filter (not protected) over c maskable from words window c as (partition by doc_id, chunk)),
rated as (select *, (case when density > 0.30 then 0.25 when density > 0.15 then 0.20 when density > 0.05 then 0.18 else 0.12 end)::double rate, (case when density > 0.30 then 0.75 when density > 0.15 then 0.65 when density > 0.05 then 0.55 else 0.35 end)::double share from dens),
budget as (select *, greatest(1, floor(maskable::double * rate))::int budget, floor(greatest(1, floor(maskable::double * rate)) * share)::int legal_budget from rated)"""
_SELECT = f"""
ranked as (select *, row_number() over (partition by doc_id, chunk, kind order by case when kind = 2 then u else -coalesce(priority, 0) end, first_pos) place, count(*) filter (kind = 0) over (partition by doc_id, chunk) phrases, count(*) filter (kind = 1) over (partition by doc_id, chunk) others
    from (select *, case when priority is null then 2 when is_phrase then 0 else 1 end kind, {u4("select", "word_id")} u from budget where not protected)),
chosen as (select doc_id, chunk, word_id, kind from (select *, least(greatest(legal_budget - phrases, 0), others) taken from ranked) where kind = 0 or (kind = 1 and place <= taken) or (kind = 2 and place <= budget - phrases - taken))"""


def lexicon_terms(spark: SparkSession) -> DataFrame:
    return frame(spark, TERMS, "idx int, term string, priority double").drop("idx")


def offline(spark: SparkSession, sf_dir: str, samples: bool | tuple[str, ...] = False) -> DataFrame:
    return masked.masked_windows(docs(spark, sf_dir), lexicon_terms(spark), masked.Offline, samples=samples)


def online(spark: SparkSession, sf_dir: str, samples: bool | tuple[str, ...] = False, **options) -> DataFrame:
    return masked.masked_windows(docs(spark, sf_dir), lexicon_terms(spark), masked.Online, samples=samples, **options)


PLACED, MADE = ("places", "outcomes"), ("input_ids", "labels")


def chosen(rows: DataFrame, legal: bool = False) -> DataFrame:
    """Counts and sums of chosen words by window and kind."""
    each = rows.select("doc_id", "chunk", F.explode(F.arrays_zip("words", "kinds")).alias("x")).select("doc_id", "chunk", F.col("x.words").alias("word_id"), F.col("x.kinds").alias("kind"))
    name = (F.col("kind") < 2).alias("legal") if legal else F.col("kind")
    return each.groupBy("doc_id", "chunk", name).agg(F.count(F.lit(1)).alias("n"), F.sum("word_id").alias("words"))


def outcomes(rows: DataFrame) -> DataFrame:
    each = rows.select("doc_id", "chunk", F.explode(F.arrays_zip("places", "outcomes")).alias("x"))
    name = F.element_at(F.array(*map(F.lit, ("mask", "random", "keep"))), F.col("x.outcomes") + 1)
    return each.groupBy("doc_id", "chunk", name.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.places").cast("long")).alias("places"))


@query("mask_budget_offline", f"with {_BUDGET} select doc_id, chunk, round(max(density), 9) density, max(rate) rate, max(share) share, max(maskable)::int maskable, max(budget)::int budget, max(legal_budget)::int legal_budget from budget group by 1, 2")
def mask_budget_offline(spark, sf_dir):
    return offline(spark, sf_dir).select("doc_id", "chunk", F.round("density", 9).alias("density"), "rate", "share", "maskable", "budget", "legal_budget")


@query("mask_select_offline", f"with {_BUDGET}, {_SELECT} select doc_id, chunk, kind::int kind, count(*) n, sum(word_id)::bigint words from chosen group by 1, 2, 3")
def mask_select_offline(spark, sf_dir):
    return chosen(offline(spark, sf_dir))


@query("mask_replace_offline", f"""with {_BUDGET}, {_SELECT}, outs as (select c.doc_id, c.chunk, t.pos, c.kind < 2 legal, {u4("replace", "t.pos", "c.doc_id", "c.chunk")} r from chosen c join {_CTOK} t on c.doc_id = t.doc_id and c.chunk = t.chunk and c.word_id = t.word_id)
    select doc_id, chunk, case when legal then case when r < 0.90 then 'mask' when r < 0.90::double + 0.05::double then 'random' else 'keep' end else case when r < 0.80 then 'mask' when r < 0.80::double + 0.10::double then 'random' else 'keep' end end outcome, count(*) n, sum(pos)::bigint places from outs group by all""")
def mask_replace_offline(spark, sf_dir):
    return outcomes(offline(spark, sf_dir, PLACED))


@query("density_rates", "select * from (values (0.31::double, 0.25::double, 0.75::double), (0.30, 0.20, 0.65), (0.15, 0.18, 0.55), (0.05, 0.12, 0.35)) t(density, rate, share)")
def density_rates(spark, sf_dir):
    rate, share = masking.rates(F.col("density"))
    return frame(spark, [(0.31,), (0.30,), (0.15,), (0.05,)], "density double").select("density", rate.alias("rate"), share.alias("share"))


# ---- online masking

_OCH = f"(select doc_id, (s / 128)::int chunk, s::int \"start\" from (select doc_id, n, unnest(generate_series(0, n - 1, 128)) s from {_N} where n > 0) where least(510, n - s) >= 50 and (s = 0 or s - 128 + 510 < n))"
_OTOK = f"(select t.doc_id, c.chunk, t.pos - c.start pos, word_id, legal from {_LEGAL} t join {_OCH} c on t.doc_id = c.doc_id and t.pos >= c.start and t.pos < c.start + 510)"


def _online_sql(word: str) -> str:
    return f"""with groups as (select doc_id, chunk, {word} word_id, bool_or(legal) legal from {_OTOK} group by all),
    ranked as (select *, row_number() over (partition by doc_id, chunk, legal order by {u4("select", "word_id")}, word_id) place, count(*) over c n, count(*) filter (legal) over c n_legal from groups window c as (partition by doc_id, chunk)),
    sized as (select *, greatest(1, floor(n::double * 0.15::double)) total from ranked), cut as (select *, least(floor(total * 0.70::double), n_legal) took from sized)
    select doc_id, chunk, legal, count(*) n, sum(word_id)::bigint words from cut where case when legal then place <= took else place <= total - took end group by all"""


@query("mask_online", _online_sql("word_id"))
def mask_online(spark, sf_dir):
    return chosen(online(spark, sf_dir), legal=True)


@query("mask_online_no_wwm", _online_sql("pos"))
def mask_online_no_wwm(spark, sf_dir):
    return chosen(online(spark, sf_dir, whole_words=False), legal=True)


# masked samples; the tokeniser has no vocabulary, so a token's id is a keyed hash of it above the special ids 0 to 4
VOCABULARY, MASK_ID = 32_000, 4
_OUT = "case when r < 0.80 then 'mask' when r < 0.80::double + 0.10::double then 'random' else 'keep' end"
_OUT_LEGAL = f"case when legal then case when r < 0.90 then 'mask' when r < 0.90::double + 0.05::double then 'random' else 'keep' end else {_OUT} end"
_CHOSEN = f"chosen as (select doc_id, chunk, word_id, legal from ({_online_sql('word_id').replace('select doc_id, chunk, legal, count(*) n, sum(word_id)::bigint words from cut', 'select doc_id, chunk, legal, word_id from cut').removesuffix(' group by all')}))"


def _samples_sql(chosen: str, starts: str, out: str) -> str:
    return f"""with {chosen}, drawn as (select t.doc_id, c.chunk, t.pos - c.start pos, t.word_id, (5 + floor({u("'id'", 't.token')} * {VOCABULARY - 5}::double))::int id from {_TOK} t join {starts} c on t.doc_id = c.doc_id and t.pos >= c.start and t.pos < c.start + 510),
    outs as (select d.*, c.word_id is not null chosen, legal, {u4("replace", "d.pos", "d.doc_id", "d.chunk")} r, floor({u4("random", "d.pos", "d.doc_id", "d.chunk")} * {VOCABULARY}::double)::int other from drawn d left join chosen c on c.doc_id = d.doc_id and c.chunk = d.chunk and c.word_id = d.word_id),
    put as (select *, {out} outcome from outs)
    select doc_id, chunk, [0]::int[] || list(case when not chosen or outcome = 'keep' then id when outcome = 'mask' then {MASK_ID} else other end order by pos)::int[] || [2]::int[] input_ids, [-100]::int[] || list(case when chosen then id else -100 end order by pos)::int[] || [-100]::int[] labels from put group by 1, 2"""


@query("mask_tokens_online", f"with {_CHOSEN}, outs as (select t.doc_id, t.chunk, t.pos, {u4("replace", "t.pos", "t.doc_id", "t.chunk")} r from chosen c join {_OTOK} t on c.doc_id = t.doc_id and c.chunk = t.chunk and c.word_id = t.word_id) select doc_id, chunk, {_OUT} outcome, count(*) n, sum(pos)::bigint places from outs group by all")
def mask_tokens_online(spark, sf_dir):
    return outcomes(online(spark, sf_dir, PLACED))


@query("mask_outcome_online", f"with {_CHOSEN}, outs as (select t.doc_id, t.chunk, t.pos, {u4("replace", "t.pos", "t.doc_id", "t.chunk")} r from chosen c join {_OTOK} t on c.doc_id = t.doc_id and c.chunk = t.chunk and c.word_id = t.word_id) select doc_id, {_OUT} outcome, count(*) n from outs group by all")
def mask_outcome_online(spark, sf_dir):
    return outcomes(online(spark, sf_dir, PLACED)).groupBy("doc_id", "outcome").agg(F.sum("n").alias("n"))


@query("mask_samples_online", _samples_sql(_CHOSEN, _OCH, _OUT))
def mask_samples_online(spark, sf_dir):
    return online(spark, sf_dir, MADE).select("doc_id", "chunk", "input_ids", "labels")


_OFFLINE_SAMPLES = _samples_sql(f"{_BUDGET}, {_SELECT.replace('chosen as (select doc_id, chunk, word_id, kind from', 'chosen as (select doc_id, chunk, word_id, kind < 2 legal from')}", _CHUNKS, _OUT_LEGAL)


@query("mask_samples_offline", _OFFLINE_SAMPLES)
def mask_samples_offline(spark, sf_dir):
    return offline(spark, sf_dir, MADE).select("doc_id", "chunk", "input_ids", "labels")


# ---- sampling

@query("shuffle_order", f"select doc_id, (row_number() over (order by {u("'order'", 'doc_id')}, doc_id) - 1)::bigint \"position\" from documents")
def shuffle_order(spark, sf_dir):
    return sampling.shuffle_order(docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("block_shuffle", f"select doc_id, block, (row_number() over (partition by block order by {u("'order'", 'doc_id')}, doc_id) - 1)::int place from (select doc_id, ((row_number() over (order by doc_id) - 1) // 100)::bigint block from documents)")
def block_shuffle(spark, sf_dir):
    return sampling.block_shuffle(docs(spark, sf_dir).select("doc_id"), "doc_id", block=100)


@query("train_val_split", f"select doc_id, case when row_number() over (order by {u("'split'", 'doc_id')}, doc_id) <= floor((count(*) over ()) * 0.9::double) then 'train' else 'validation' end part from documents")
def train_val_split(spark, sf_dir):
    return sampling.split(docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("worker_shards", "select i::int i, case when i < 2 then 0 when i < 4 then 1 when i < 6 then 2 else 3 end::int worker from range(11) t(i)")
def worker_shards(spark, sf_dir):
    rows = spark.range(11).select(F.col("id").cast("int").alias("i"))
    return rows.select("i", sampling.shard(F.col("i"), F.lit(11), 4).alias("worker"))


_ORD = f"(select doc_id, n, (row_number() over (order by {u("'order'", 'doc_id')}, doc_id) - 1) p from {_N})"


@query("batch_pad", f"""with samples as ({_samples_sql(_CHOSEN, _OCH, _OUT)}),
    placed as (select *, row_number() over (order by {u("'order'", 'doc_id', 'chunk')}, doc_id, chunk) - 1 p from samples),
    wide as (select *, p // 8 batch_id, max(len(input_ids)) over (partition by p // 8) width from placed qualify count(*) over (partition by p // 8) = 8)
    select batch_id, doc_id, chunk, list_resize(input_ids, width, 1)::int[] input_ids, list_resize(labels, width, -100)::int[] labels, len(input_ids)::int "real" from wide""")
def batch_pad(spark, sf_dir):
    """Masked samples in shuffled batches of eight, padded to the longest of their batch; an incomplete last batch goes."""
    return padded_batches(docs(spark, sf_dir), lexicon_terms(spark))


def padded_batches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Batches and widths come from the texts' numbers of tokens; they go to the texts, so that samples, many times as large, are made once and never move. Texts that share a doc_id are told apart by their digests."""
    from pyspark.sql.window import Window

    copies = Window.partitionBy("_doc").orderBy("_digest")
    keyed = texts.select("doc_id", "text", F.struct("doc_id").alias("_doc"), F.md5("text").alias("_digest"))  # as a struct a null equals itself
    copy = F.row_number().over(copies).alias("_copy")
    starts = tokens.with_count(keyed, ["doc_id", "_doc", "_digest"]).select("doc_id", "_doc", copy, "n")
    rows = windows.windows(starts, windows.online_starts(F.col("n"))).withColumn("_u", uniform("order", "doc_id", "chunk"))
    placed = sampling.batches(sampling.with_position(rows, ["_u", "doc_id", "chunk"]), "position", 8, drop_last=False)
    together = Window.partitionBy("batch_id")
    whole = F.when(F.count(F.lit(1)).over(together) == 8, F.col("batch_id")).alias("batch_id")
    placed = placed.select("_doc", "_copy", "chunk", whole, (F.max("size").over(together) + 2).alias("width"))
    mine = placed.groupBy("_doc").agg(F.collect_list(F.struct("_copy", "chunk", "batch_id", "width")).alias("_all"))
    dealt = keyed.select("doc_id", "text", "_doc", copy).join(mine, "_doc")
    dealt = dealt.withColumn("_all", F.array_sort(F.filter("_all", lambda x: x["_copy"] == F.col("_copy")))).select("doc_id", "text", F.col("_all.batch_id").alias("batch_id"), F.col("_all.width").alias("width"))
    rows = masked.masked_windows(dealt, terms, masked.Online, samples=MADE, each=("batch_id", "width")).where("batch_id is not null")
    size = F.size("input_ids")
    return rows.select("batch_id", "doc_id", "chunk", masking.pad(F.col("input_ids"), F.col("width"), 1).alias("input_ids"), masking.pad(F.col("labels"), F.col("width"), -100).alias("labels"), size.alias("real"))


_PAD = [(0, [7, 8, 9], [-100, 8, -100]), (0, [5], [5]), (1, [4], None)]


@query("premasked_pad", "select b::int b, ids, attention, labels from (values (0, [7, 8, 9]::int[], [1, 1, 1]::int[], [-100, 8, -100]::int[]), (0, [5, 1, 1], [1, 0, 0], [5, -100, -100]), (1, [4], [1], [-100])) t(b, ids, attention, labels)")
def premasked_pad(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = frame(spark, _PAD, "b int, ids array<int>, labels array<int>").withColumn("labels", F.coalesce("labels", F.transform("ids", lambda _: F.lit(-100))))
    size = F.max(F.size("ids")).over(Window.partitionBy("b"))
    rows = rows.withColumn("size", size)
    return rows.select("b", masking.pad(F.col("ids"), F.col("size"), 1).alias("ids"), masking.pad(F.transform("ids", lambda _: F.lit(1)), F.col("size"), 0).alias("attention"), masking.pad(F.col("labels"), F.col("size"), -100).alias("labels"))


@query("step_math", "select n::bigint samples, (ceil(ceil(n / 8.0) / 4.0) * 3)::bigint steps, floor(ceil(ceil(n / 8.0) / 4.0) * 3 * 0.1::double)::bigint warm_up from (select count(*) n from documents)")
def step_math(spark, sf_dir):
    n = docs(spark, sf_dir).count()
    return frame(spark, [(n, *analysis.steps(n, 8, 4, 3))], "samples long, steps long, warm_up long")


# ---- acquisition

CATALOG = [("en", ["a", "b", "c"], 40), ("fr", ["d"], 7), ("de", ["e", "f"], 1), ("es", [], 9)]
_CAT = values([(c, i, q, max(1, w // len(qs))) for c, qs, w in CATALOG for i, q in enumerate(qs)], "chamber", "query_idx", "query", "allowed")


def catalog(spark: SparkSession) -> DataFrame:
    return frame(spark, CATALOG, "chamber string, queries array<string>, weight int")


@query("query_allocation", f"select chamber, query_idx::int query_idx, query, allowed::int allowed from {_CAT}")
def query_allocation(spark, sf_dir):
    return acquisition.expand(catalog(spark))


@query("stratified_allocation", f"select doc_id, lang, query from (select d.doc_id, d.lang, c.query, c.allowed, row_number() over (partition by c.chamber, c.query order by {u("'order'", 'd.doc_id', 'c.query')}, d.doc_id) rn from documents d join {_CAT} c on d.lang = c.chamber) where rn <= allowed")
def stratified_allocation(spark, sf_dir):
    plan = acquisition.expand(catalog(spark))
    rows = docs(spark, sf_dir).select("doc_id", "lang").join(F.broadcast(plan), F.col("lang") == F.col("chamber"))  # a catalog has hundreds of rows
    return sampling.first_per_group(rows, ["chamber", "query"], [uniform("order", "doc_id", "query"), F.col("doc_id")], F.col("allowed")).select("doc_id", "lang", "query")


@query("first_wins_dedup", "select id, doc_id from (select md5(text) id, doc_id, row_number() over (partition by md5(text) order by doc_id) rn from documents) where rn = 1")
def first_wins_dedup(spark, sf_dir):
    return acquisition.first_wins(docs(spark, sf_dir).select(F.md5("text").alias("id"), "doc_id"), [F.col("doc_id")])


@query("anti_join_seen", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null) and source not in ('src1', 'src2')")
def anti_join_seen(spark, sf_dir):
    seen = table(spark, sf_dir, "labels").select("doc_id").union(docs(spark, sf_dir).where("source in ('src1', 'src2')").select("doc_id"))
    return acquisition.unseen(docs(spark, sf_dir), seen, "doc_id").select("doc_id")


@query("processed_queries", f"select chamber, query from {_CAT} where chamber || ':' || query not in ('en:a', 'de:f')")
def processed_queries(spark, sf_dir):
    plan = acquisition.expand(catalog(spark)).withColumn("id", F.concat_ws(":", "chamber", "query"))
    return acquisition.unseen(plan, frame(spark, [("en:a",), ("de:f",)], "id string")).select("chamber", "query")


_HIT = [("1", "x.txt", "1. Hukuk Dairesi", "q", "ok text"), ("2", "y.txt", "c", "q", 'x FMTY":"ERROR y'), ("3", "z.txt", "c", "q", "ADALET_RUNTIME_EXCEPTION" + "z" * 300), ("4", "w.txt", "c", "q", None)]


@query("quarantine_split", f"select id, filename, chamber, query, fetched_at, substr(text, 1, 200) error_snippet from (select *, timestamp '2024-01-01' fetched_at from {values(_HIT, 'id', 'filename', 'chamber', 'query', 'text')}) where id in ('2', '3')")
def quarantine_split(spark, sf_dir):
    return acquisition.quarantine(frame(spark, _HIT, "id string, filename string, chamber string, query string, text string"), F.lit("2024-01-01").cast("timestamp"))


@query("record_enrichment", f"select id, filename original_filename, chamber court, case id when '1' then '1_hukuk_dairesi' else 'c' end chamber_slug from {values(_HIT, 'id', 'filename', 'chamber', 'query', 'text')}")
def record_enrichment(spark, sf_dir):
    rows = acquisition.enrich(frame(spark, _HIT, "id string, filename string, chamber string, query string, text string"), "chamber", F.lit("2024-01-01").cast("timestamp"))
    return rows.select("id", "meta.original_filename", "meta.court", "chamber_slug")


# ---- analysis

_SAMPLE = [(1, ["▁ka", "rar", "▁X", "y", "z"], [5, 6, -100, 8, -100]), (2, ["▁", "▁a", "b"], [1, 2, 3]), (3, ["a"], [-100])]


def sample_tokens(spark: SparkSession) -> DataFrame:
    rows = frame(spark, _SAMPLE, "sample_id int, tokens array<string>, labels array<int>")
    return rows.select("sample_id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("pos", "x")).select("sample_id", "pos", F.col("x.tokens").alias("token"), F.col("x.labels").alias("label"))


@query("reconstruct_words", "select sample_id::int sample_id, word, \"start\"::int \"start\", \"end\"::int \"end\", n_tokens::int n_tokens from (values (1, 'karar', 0, 1, 2), (1, 'y', null, 3, 1), (2, 'ab', 1, 2, 2)) t(sample_id, word, \"start\", \"end\", n_tokens)")
def reconstruct_words(spark, sf_dir):
    return analysis.reconstruct(sample_tokens(spark)).drop("word_no")


@query("mask_outcome_stats", "select * from (values (1::int, 1::int, 1::int, 1::int, 1::int, 100 / 3.0::double, 100 / 3.0::double, 100 / 3.0::double), (2, 2, 0, 0, 0, null, null, null)) t(id, unmasked, masked, kept, replaced, masked_share, kept_share, replaced_share)")
def mask_outcome_stats(spark, sf_dir):
    rows = frame(spark, [(1, [99, 5, 7, 9], [4, 5, 8, -100]), (2, [1, 2], [-100, -100])], "id int, ids array<int>, labels array<int>")
    counts = analysis.outcomes("ids", "labels", 99)
    return rows.select("id", *[c.alias(n) for n, c in {**counts, **analysis.shares(counts)}.items()])


@query("mask_outcomes_of_samples", f"""with samples as ({_OFFLINE_SAMPLES}), each as (select doc_id, chunk, unnest(input_ids) i, unnest(labels) l from samples)
    select doc_id, chunk, count(*) filter (l = -100) unmasked, count(*) filter (l != -100 and i = {MASK_ID}) masked, count(*) filter (l != -100 and i != {MASK_ID} and i = l) kept, count(*) filter (l != -100 and i != {MASK_ID} and i != l) replaced from each group by 1, 2""")
def mask_outcomes_of_samples(spark, sf_dir):
    """What masking did to every sample, counted from its ids and labels alone."""
    counts = analysis.outcomes("input_ids", "labels", MASK_ID)
    return mask_samples_offline(spark, sf_dir).select("doc_id", "chunk", *[c.cast("long").alias(n) for n, c in counts.items()])


@query("sample_words", f"""with samples as ({_OFFLINE_SAMPLES}), each as (select doc_id, chunk, unnest(labels) l, generate_subscripts(labels, 1) - 1 pos from samples)
    select doc_id, chunk, count(*) n, sum(pos)::bigint places, count(*) filter (l % 7 = 0) named from each where l != -100 and l % 3 != 0 group by 1, 2""")
def sample_words(spark, sf_dir):
    """Labelled tokens of every sample by a vocabulary that names two ids of three, every seventh with a mark."""
    vocabulary = spark.range(VOCABULARY).where("id % 3 != 0").select(F.col("id").cast("int").alias("id"), F.concat(F.when(F.col("id") % 7 == 0, "▁").otherwise(""), F.col("id").cast("string")).alias("token"))
    samples = mask_samples_offline(spark, sf_dir).withColumn("sample_id", F.struct("doc_id", "chunk"))
    rows = analysis.named(samples, vocabulary).where(F.col("label") != analysis.IGNORED).where("original is not null")
    return rows.groupBy("sample_id.doc_id", "sample_id.chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("long")).alias("places"), F.count_if(F.col("original").startswith("▁")).alias("named"))


@query("progress_counts", "select source, count(*) filter (not contains(text, 'tion')) saved, count(*) filter (contains(text, 'tion')) corrupted, count(*) total from documents group by rollup (source)")
def progress_counts(spark, sf_dir):
    marked = docs(spark, sf_dir).withColumn("text", F.when(F.contains("text", F.lit("tion")), acquisition.CORRUPT[0]).otherwise(F.col("text")))
    return analysis.progress(marked, "source")


@query("classify_words", "select * from (values ('Ceza', 'single'), ('mahkemesi', 'partial'), ('hacizli', 'partial'), ('cezalı', 'none')) t(word, class)")
def classify_words(spark, sf_dir):
    return analysis.classify(frame(spark, [("Ceza",), ("mahkemesi",), ("hacizli",), ("cezalı",)], "word string"), frame(spark, [("ceza",), ("haciz",), ("ağır ceza mahkemesi",)], "term string"))


_WORDS = "(select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 place from (select doc_id, regexp_extract_all(lower(text), '\\p{L}+') w from documents))"
_CLASS = "case when word in ('the', 'and', 'that') then 'single' when word in ('of', 'thing') or contains(word, 'thing') or contains(word, 'ingth') then 'partial' else 'none' end"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("place", "word"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.classify(words(spark, sf_dir), frame(spark, [("the",), ("and",), ("that",), ("thing",), ("ingth",), ("of thing",)], "term string"))


@query("class_share", f"select class, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 6) share from (select case when word in ('thing', 'ingth') then 'single' else {_CLASS} end class from {_WORDS}) group by 1")
def class_share(spark, sf_dir):
    rows = classified(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over a row per class
    return rows.select("class", "n", F.round(F.lit(100.0) * F.col("n") / total, 6).alias("share"))


@query("consecutive_phrases", f"""select doc_id, phrase, count(*) n, sum("start")::bigint places from (select doc_id, place "start", word || ' ' || lead(word) over w phrase from {_WORDS} window w as (partition by doc_id order by place)) where phrase in ('of the', 'in the', 'the and') group by 1, 2""")
def consecutive_phrases(spark, sf_dir):
    found = analysis.consecutive(words(spark, sf_dir), frame(spark, [("of the",), ("in the",), ("the and",)], "phrase string"), "doc_id")
    return found.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("long")).alias("places"))


@query("top_words", f"select word, count(*) n from {_WORDS} group by word order by count(*) desc, min({{'d': doc_id, 'p': place}}) limit 15")
def top_words(spark, sf_dir):
    first = F.min(F.struct("doc_id", "place"))
    return words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").limit(15).select("word", "n")


_RATIO = "(select doc_id, count(*) filter (word in ('the', 'and', 'that', 'of', 'in'))::double / count(*) r, count(*) n from " + _WORDS + " group by 1)"


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("doc_id").agg((F.count_if(F.col("word").isin("the", "and", "that", "of", "in")).cast("double") / F.count(F.lit(1))).alias("r"), F.count(F.lit(1)).alias("n"))


@query("ratio_histogram", f"select (case when r < 1 then floor(r * 5) end)::int bin, count(*) n from {_RATIO} group by 1")
def ratio_histogram(spark, sf_dir):
    return ratios(spark, sf_dir).groupBy(analysis.ratio_bin(F.col("r")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("ratio_mean", f"select round(avg(r), 9) mean_ratio, sum(n)::bigint total_words, count(*) samples from {_RATIO}")
def ratio_mean(spark, sf_dir):
    return ratios(spark, sf_dir).agg(F.round(F.avg("r"), 9).alias("mean_ratio"), F.sum("n").alias("total_words"), F.count(F.lit(1)).alias("samples"))


@query("word_length_stats", f"select round(avg(length(word)), 9) mean, quantile_cont(length(word), 0.5)::double median, max(length(word))::int longest from {_WORDS}")
def word_length_stats(spark, sf_dir):
    n = F.length("word")
    return words(spark, sf_dir).agg(F.round(F.avg(n), 9).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("longest"))


@query("phrase_sample_rate", "select role, count(*) samples, count(*) filter (contains(lower(text), 'of the')) with_phrase, round(100.0::double * count(*) filter (contains(lower(text), 'of the')) / count(*), 6) rate from conversations group by 1")
def phrase_sample_rate(spark, sf_dir):
    hit = F.count_if(F.contains(F.lower("text"), F.lit("of the")))
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(n.alias("samples"), hit.alias("with_phrase"), F.round(F.lit(100.0) * hit / n, 6).alias("rate"))


@query("throughput_windows", "select time_bucket(interval '30 seconds', ts) started, round(sum(value) / 30, 6) per_second, round(sum(user_id) / 30.0::double, 6) other_per_second, count(*) steps, round(30000.0::double / count(*), 6) mean_step_ms from events group by 1")
def throughput_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "30 seconds").alias("w")).agg(F.round(F.sum("value") / 30, 6).alias("per_second"), F.round(F.sum("user_id") / 30, 6).alias("other_per_second"), F.count(F.lit(1)).alias("steps"))
    return rows.select(F.col("w.start").alias("started"), "per_second", "other_per_second", "steps", F.round(F.lit(30000.0) / F.col("steps"), 6).alias("mean_step_ms"))


@query("perplexity", "select event_type, round(avg(value), 6) loss, case when avg(value) < 100 then exp(round(avg(value), 6)) else 'Infinity'::double end ppl from events group by 1")
def perplexity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("loss"))
    return rows.select("event_type", "loss", analysis.perplexity(F.col("loss")).alias("ppl"))


@query("retention_topk", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) rn from events) where rn <= 3")
def retention_topk(spark, sf_dir):
    return sinks.newest(table(spark, sf_dir, "events"), 3, "event_id", "user_id").select("user_id", "event_id")


@query("sample_cap", "select doc_id from (select doc_id, row_number() over (order by doc_id) rn from documents) where rn <= 1000")
def sample_cap(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").orderBy("doc_id").limit(1000)  # the capped report of the analyzer


# ---- streams

@query("stream_dedup", "select distinct user_id from events")
def stream_dedup(spark, sf_dir):
    return streams.drain(streams.first_wins(streams.read_table(spark, f"{sf_dir}/events.parquet").select("user_id"), "user_id"))


@query("stream_file_dataset", "select lang, count(*) n, sum(length(text))::bigint chars from documents group by 1")
def stream_file_dataset(spark, sf_dir):
    rows = streams.read_table(spark, f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return streams.drain(rows, "complete")


@query("stream_event_windows", "select time_bucket(interval '1 hour', ts) started, event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2")
def stream_event_windows(spark, sf_dir):
    rows = streams.drain(streams.event_windows(streams.read_table(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour"), "complete")
    return rows.select(F.col("window.start").alias("started"), "event_type", "n", F.round("total", 6).alias("total"))
