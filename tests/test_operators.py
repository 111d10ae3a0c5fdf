"""Properties of operators that queries alone do not show."""

import hashlib
import json
import random
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.functions.keyed import uniform
from corvane.config import Settings
from corvane.operators import analysis, digests, masked, masking, matching, sampling, tokens, windows
from corvane.operators.components import connected_components
from corvane.plans import corpus_queries
from corvane.sources import readers, sinks
from corvane.sources.search_api import SearchReader, SearchSource, SearchStream
from corvane.storage import spread
from corvane.streaming import streams


def test_window_counts_match_closed_forms(spark):
    rows = spark.range(0, 1500).select(F.col("id").cast("int").alias("n"))
    for r in rows.select("n", F.size(windows.offline_starts(F.col("n"))).alias("off"), F.size(windows.online_starts(F.col("n"))).alias("on")).collect():
        n = r["n"]
        assert r["off"] == ((n - 10) // 256 + 1 if n >= 10 else 0)
        assert r["on"] == (0 if n < 50 else 1 if n <= 510 else -(-(n - 510) // 128) + 1)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), *[(i, i + 1) for i in range(100, 160)]], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[8] == got[9] == 8 and got[5] == 5 and 4 not in got
    assert all(got[i] == 100 for i in range(100, 161))
    assert connected_components(edges.limit(0)).count() == 0


def test_components_of_long_paths_with_shuffled_ids(spark):
    rng = random.Random(5)
    ids = rng.sample(range(1 << 40), 6003)
    paths = [ids[:3000], ids[3000:6000], ids[6000:]]
    edges = spark.createDataFrame([e for p in paths for e in zip(p, p[1:])], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: min(p) for p in paths for i in p}


def test_analysis_over_all_documents_leaves_out_no_language(spark, tmp_path):
    rows = [(1, "the house", "en"), (2, "Die schöne Straße", "de"), (3, "été", None), (4, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = {n: corpus_queries.QUERIES[n](spark, str(tmp_path)) for n in ("ratio_mean", "top_words", "word_length_stats", "class_share", "ratio_histogram", "consecutive_phrases")}
    mean = run["ratio_mean"].first()
    assert (mean["samples"], mean["total_words"]) == (3, 6)
    assert {r["word"] for r in run["top_words"].collect()} == {"the", "house", "die", "schöne", "straße", "été"}
    assert run["word_length_stats"].first()["longest"] == 6
    assert sum(r["n"] for r in run["class_share"].collect()) == 6 and sum(r["n"] for r in run["ratio_histogram"].collect()) == 3
    assert run["consecutive_phrases"].count() == 0


def test_masked_samples_hold_an_outcome_for_every_selected_token(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_queries.mask_samples_online(spark, sf).collect()
    chosen = {(r["doc_id"], r["chunk"]): 0 for r in rows}
    for r in corpus_queries.mask_tokens_online(spark, sf).collect():
        chosen[r["doc_id"], r["chunk"]] += r["n"]
    sizes = {(r["doc_id"], r["chunk"]): r["size"] for r in windows.windows(corpus_queries.counts(spark, sf), windows.online_starts(F.col("n"))).collect()}
    assert len(rows) == len(sizes) > 100
    masked = kept = n = 0
    for r in rows:
        ids, labels = r["input_ids"], r["labels"]
        assert len(ids) == len(labels) == sizes[r["doc_id"], r["chunk"]] + 2 and (ids[0], ids[-1], labels[0], labels[-1]) == (0, 2, -100, -100)
        picked = [(i, x) for i, x in zip(ids, labels, strict=True) if x != -100]
        assert len(picked) == chosen[r["doc_id"], r["chunk"]]
        n, masked, kept = n + len(picked), masked + sum(i == 4 for i, _ in picked), kept + sum(i == x for i, x in picked)
    assert abs(masked / n - 0.8) < 0.02 and abs(kept / n - 0.1) < 0.02


def test_keyed_numbers_ignore_partitions(spark):
    rows = spark.range(100)
    one, many = (sorted(r["u"] for r in rows.repartition(n).select(uniform("x", "id").alias("u")).collect()) for n in (1, 7))
    assert one == many and 0 <= one[0] and one[-1] < 1


def test_tokens_are_their_offsets(spark):
    texts = [None, "", " \t\n", "Ağ5ır  ceza.\u00a0x", "\U0001f600a b" * 3, "a\u0301 1" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in tokens.tokenize(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sorted(got) == [3, 4, 5]
    for i, rows in got.items():
        rows.sort(key=lambda r: r["pos"])
        text = texts[i]
        assert [r["pos"] for r in rows] == list(range(len(rows)))
        assert all(text[r["start_at"] : r["end_at"]] == r["token"] for r in rows)
        words = [w for w in text.replace("\u00a0", "\x00").split()]
        assert ["".join(r["token"] for r in rows if r["word_id"] == w) for w in range(min(3, len(words)))] == [w.replace("\x00", "\u00a0") for w in words[:3]]
        assert rows[-1]["word_id"] == len(words) - 1


def test_matches_equal_brute_force(spark, monkeypatch):
    words = ["aa", "a", "aba", "b", "ğa", "", None, "b"]
    texts = [None, "", "aabaaba", "ğağa" * 40, "\U0001f600ab", "zzz"]
    terms = spark.createDataFrame([(w, float(i)) for i, w in enumerate(words)], "term string, priority double")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, norm string")
    want = sorted((d, w, float(i), s, s + len(w)) for d, t in enumerate(texts) for i, w in enumerate(words) if w for s in range(len(t or "")) if t.startswith(w, s))
    assert sorted(map(tuple, matching.overlapping(docs, terms).collect())) == want
    monkeypatch.setattr(matching, "MOST_TERMS", 2)  # several automata
    assert sorted(map(tuple, matching.overlapping(docs, terms).collect())) == want
    assert matching.overlapping(docs, terms.limit(0)).count() == matching.overlapping(docs.limit(0), terms).count() == 0
    longest = []
    for d, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            size = max((len(w) for w in words if w and t.startswith(w, at)), default=0)
            longest += [(d, at, at + size)] if size else []
            at += size or 1
    assert sorted(map(tuple, matching.greedy(docs, [w for w in words if w]).collect())) == longest


def test_spans_longer_than_a_cell(spark):
    rows = [(1, i, 3 * i, 3 * i + 2, i, "xx") for i in range(100)]
    toks = spark.createDataFrame(rows, "doc_id int, pos long, start_at long, end_at long, word_id long, token string")
    spans = spark.createDataFrame([(1, 10, 140), (1, 20, 60), (1, 200, 200), (1, 297, 298)], "doc_id int, s long, e long")
    got = {r["pos"] for r in matching.tokens_in_spans(toks, spans).collect() if r["legal"]}
    assert got == {i for _, i, a, b, _, _ in rows if 10 <= (a + b) / 2 < 140}
    hits = spark.createDataFrame([(1, "x " * 60, 2.0, 30, 150), (1, "xx", 3.0, 0, 2)], "doc_id int, term string, priority double, s long, e long")
    found = {r["word_id"]: (r["priority"], r["is_phrase"]) for r in masking.word_map(toks, hits).collect()}
    assert found == {0: (3.0, False), **{i: (5.0, True) for i in range(10, 50)}}


def test_online_budget_moves_to_other_words(spark):
    docs = spark.createDataFrame([(1, " ".join(["lex"] * 4 + ["other"] * 96))], "doc_id int, text string")
    (row,) = masked.masked_windows(docs, spark.createDataFrame([("lex", 1.0)], "term string, priority double"), masked.Online).collect()
    assert (row["kinds"].count(1), row["kinds"].count(2), row["budget"]) == (4, 11, 15) and set(row["words"][:4]) == {0, 1, 2, 3}


def test_outcome_shares():
    u = masked.uniforms("replace", 1, 0, 0, 19_999)
    for kind, want in ((2, (0.8, 0.1, 0.1)), (1, (0.9, 0.05, 0.05))):
        got = np.bincount(masked.Offline.outcome(None, u, np.full(20_000, kind)), minlength=3) / 20_000
        assert np.abs(got - want).max() < 0.01
    assert (masked.uniforms("replace", 1, 0, 5, 11) == u[5:12]).all()


def test_masking_guards(spark):
    """Texts whose folding changes their length match nothing; special and protected tokens stay; odd rows have no windows."""
    terms = spark.createDataFrame([("and", 2.0), (None, 1.0)], "term string, priority double")
    tokens_of = tokens.RegexTokenizer()
    grows = masked.Lexicon([("and", 2.0)], fold=lambda t: t.lower().replace("x", "xx"))
    assert np.isnan(grows.words("x and", tokens_of("x and"))[0]).all() and grows.words("y and", tokens_of("y and"))[0][1] == 2.0
    text = "ve bir , and word " * 60
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "too short"), (None, text), (6, "ve " * 30)], "doc_id int, text string")
    got = masked.masked_windows(rows.withColumn("chunk", F.lit("clash")), terms, masked.Offline).collect()
    assert {r["doc_id"] for r in got} == {1, 6, None} and not [r for r in got if r["doc_id"] == 6][0]["words"]
    for r in got:
        there = [t for t in tokens_of(text if r["doc_id"] != 6 else "ve " * 30).strings[r["start"] : r["start"] + r["size"]]]
        assert {there[p] for p in r["places"]} <= {"and", "word"}
    assert sorted(map(str, (r for r in got if r["doc_id"] == 1)))[::2] == sorted(map(str, (r for r in got if r["doc_id"] == 1)))[1::2]


def test_library_tokenizer_makes_samples(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    names = [a["content"] for a in json.loads(open(path, encoding="utf-8").read())["added_tokens"]][:2]
    tokenizer = tokens.LibraryTokenizer(path, names[0], names[-1], names[0])
    text = "the river and the mountain " * 40
    found = tokenizer(text)
    theirs = Tokenizer.from_file(path).encode(text, add_special_tokens=False)
    assert found.ids.tolist() == theirs.ids and [tuple(x) for x in np.stack([found.starts, found.ends], 1)] == theirs.offsets and found.words[0] == 0 and (np.diff(found.words) <= 1).all()
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    for policy in (masked.Offline, masked.Online):
        for r in masked.masked_windows(docs, spark.createDataFrame([("river", 1.0)], "term string, priority double"), policy, tokenizer).collect():
            assert len(r["input_ids"]) == len(r["labels"]) == r["size"] + 2 and (r["input_ids"][0], r["input_ids"][-1]) == tokenizer.around
            own = found.ids[r["start"] : r["start"] + r["size"]].tolist()
            chosen = {p for p, x in enumerate(r["labels"][1:-1]) if x != -100}
            assert chosen == set(r["places"]) and all(r["labels"][p + 1] == own[p] for p in chosen)
            assert all(r["input_ids"][p + 1] == own[p] for p in range(r["size"]) if p not in chosen)
    assert tokenizer.protected(["the"])(found).any()


def test_spaced_letters_equal_plain_regex(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abÇ1. \t\n ") for _ in range(rng.randrange(40))) for _ in range(4000)] + ["a " * 20_000 + "b"]
    classes = [text.UPPER, text.LOWER, r"\d", text.UPPER + text.LOWER]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for letters in classes:
        got = {r["i"]: r["c"] for r in rows.select("i", text.join_spaced(F.col("t"), letters).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == re.sub(rf"\b(?:[{letters}]\s+){{2,}}[{letters}]\b", lambda m: m.group().replace(" ", "").replace("\t", ""), t), (letters, t)


def test_positions_are_whole(spark):
    got = sampling.with_position(spark.range(500).repartition(5), ["id"]).collect()
    assert all(r["id"] == r["position"] for r in got) and len(got) == 500


def test_shards_with_few_files(spark):
    got = [r["w"] for r in spark.range(3).select(sampling.shard(F.col("id"), F.lit(3), 4).alias("w")).collect()]
    assert got == [3, 3, 3]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n\n{bad\n{"id": "2"}\n')
    rows = readers.json_lines(spark, str(tmp_path))
    total = [r for r in readers.file_stats(rows).collect() if r["source_file"] is None][0]
    assert (total["read"], total["saved"], total["skipped"], total["errors"]) == (3, 1, 1, 1)
    assert [(r["id"], r["text"]) for r in readers.with_text(rows, "empty").collect()] == [("1", "x"), ("2", "")] and readers.with_text(rows).count() == 1
    (tmp_path / "blank.jsonl").write_text("\t\n \u00a0\n")
    assert readers.json_lines(spark, str(tmp_path / "blank.jsonl")).count() == 0
    (tmp_path / "b.txt").write_text("  a whole\nfile \n\n\t")
    assert [r["text"] for r in readers.text_files(spark, str(tmp_path)).collect()] == ["a whole\nfile"]
    assert readers.json_file(spark, str(tmp_path / "missing.json")).count() == 0
    sinks.append_json(spark.createDataFrame([("g", 1)], "g string, v int"), str(tmp_path / "out"), "g")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    sinks.term_file(spark.createDataFrame([("a",), ("bbb",)], "term string"), str(tmp_path / "terms"))
    assert [r["value"] for r in readers.term_file(spark, str(tmp_path / "terms"), 1).collect()] == ["bbb", "a"]
    assert "totals" in json.loads(sinks.report(spark.range(1), "m", {"a": 1}).first()["value"])


def test_search_source(spark):
    options = {"queries": json.dumps([{"query": "q", "limit": 2}]), "pause": "0", "on_error": "skip"}
    reader = SearchReader(options, lambda o, q: (200, [{"id": 1, "text": "t", "filename": "f"}, {"text": "u"}]))
    (part,) = reader.partitions()
    assert list(reader.read(part)) == [("q", 0, "1", "t", "f", 200), ("q", 1, "None", "u", None, 200)]
    assert SearchSource.name() == "search_api"


def test_samples_are_read_in_file_order(spark, tmp_path):
    for name, first in (("a", 0), ("b", 10)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"input_ids": [i, 1], **({"labels": [-100, i]} if i % 2 else {})}) + "\n" for i in range(first, first + 10)) + "{bad\n\n")
    rows = readers.pretokenized(spark, str(tmp_path), max_samples=13).collect()
    assert sorted(r["input_ids"][0] for r in rows) == list(range(13)) and sorted(r["position"] for r in rows) == list(range(13))
    assert all(r["attention_mask"] == [1, 1] and r["labels"] == ([-100, r["input_ids"][0]] if r["input_ids"][0] % 2 else [-100, -100]) for r in rows)
    assert readers.pretokenized(spark, str(tmp_path)).count() == 20
    assert [r["input_ids"][0] for r in sorted(readers.masked_samples(spark, str(tmp_path), cap=6).collect(), key=lambda r: r["sample_id"])] == [1, 3, 5]


def test_stream_and_table_of_files_agree(spark, tmp_path):
    for i, t in enumerate(["one\n", " two \t", "\n"]):
        (tmp_path / f"{i}.txt").write_text(t)
    table, stream = (streams.dataset(spark, str(tmp_path), streaming, least=1) for streaming in (False, True))
    assert sorted(r["text"] for r in table.collect()) == sorted(r["text"] for r in streams.drain(stream).collect()) == ["one", "two"]


def test_search_errors_and_retries(monkeypatch):
    import urllib.error

    options = {"queries": json.dumps([{"query": "q"}] * 20), "pause": "0", "url": "http://127.0.0.1:9", "index": "i"}
    for error in (urllib.error.URLError("down"), TimeoutError(), json.JSONDecodeError("bad", "", 0), ConnectionResetError()):
        def fail(*_, error=error, **__):
            raise error
        monkeypatch.setattr("urllib.request.urlopen", fail)
        reader = SearchReader(options)
        assert list(reader.read(reader.partitions()[0])) == []
        with pytest.raises(RuntimeError):
            list(SearchReader({**options, "on_error": "fail"}).read(reader.partitions()[0]))
    answers = [(0, []), (503, []), (429, []), (200, [{"id": 7}]), (200, [])]
    reader = SearchReader({**options, "retry": "3"}, lambda o, q: answers.pop(0))
    assert [r[2] for r in reader.read(reader.partitions()[0])] == ["7"] and len(answers) == 1
    stream = SearchStream(options, lambda o, q: (200, []))
    assert stream.initialOffset() == {"next": 0} and stream.latestOffset() == {"next": 8} and stream.latestOffset() == {"next": 16} and stream.latestOffset() == {"next": 20}
    again = SearchStream(options)  # started anew from a checkpoint
    again.commit({"next": 16})
    assert again.latestOffset() == {"next": 20} and len(again.partitions({"next": 16}, {"next": 20})) == 4


def test_settings_and_reports(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"batch_size": "16", "epochs": 2, "unknown": 1, "seed": null}')
    found = Settings.load(str(tmp_path / "s.json"))
    assert (found.batch_size, found.epochs, found.seed) == (16, 2, "order")
    assert found.override(epochs=0, batch_size=4).epochs == 2 and found.override(explicit=True, epochs=0).epochs == 0
    assert analysis.table_text(spark.createDataFrame([("a", 1.5), ("bb", None)], "name string, x double"), "T") == "T\n=\nname  x\na     1.500\nbb"


def test_steps():
    assert analysis.steps(1000, 8, 4, 3) == (96, 9)


def test_spread_only_where_cores_would_idle(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = (spread(spark.range(0, 100, 1, n), "id") for n in (1, cores))
    assert few.rdd.getNumPartitions() == cores and few.count() == 100
    assert many.rdd.getNumPartitions() == cores and "Exchange" not in many._jdf.queryExecution().toString()


def test_rules_see_their_input_once_and_whole(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x" * 49,), ("x" * 50,), ("Karar: " + "y" * 101,), ("ｘ" * 60,)], "t string")
    got = [r["c"] for r in rows.coalesce(1).select(text.clean(F.col("t")).alias("c")).collect()]
    assert got == [None, None, None, "x" * 50, "y" * 101, "x" * 60]


def test_cleaning_queries_keep_what_their_sql_keeps(spark, tmp_path):
    """Quotes at the ends, white space beyond ASCII, texts that quotes make long enough."""
    import duckdb

    from corvane.plans.registry import ORACLES, QUERIES

    body = "and of the " * 5
    texts = ['"' + body + 'end"', body + '= "x1"', "'`" + body + "`'", '""', "`\"'" + body, "\xa0" + body + "\xa0", body + "\u2003\u2003x", '"' + "a" * 48 + '"', "w " * 250 + "\xa0" + "ab " * 60 + '"', " \t" + body + "\n"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("tx_final", "tx_extract_content", "clean_minimal_windows", "clean_stats_rollup"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(f'\"{c}\"' for c in got.columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name


def test_digests_equal_hashlib():
    rng = np.random.default_rng(0)
    heads = [f"select|{i * 7919}|{i % 50}|".encode() for i in range(50)] + [b"x" * 60, b"y" * 53 + b"|", b"", "ğ|".encode() * 30]
    of, numbers = rng.integers(0, len(heads), 9000), rng.integers(0, 130, 9000)
    for n in (numbers, np.where(numbers == 7, 10**12, numbers)):
        want = [hashlib.md5(heads[o] + str(k).encode()).hexdigest() for o, k in zip(of, n, strict=True)]
        assert ["".join(f"{x:08x}" for x in r) for r in digests.numbered_md5(heads, of, n).tolist()] == want
    words = [b"", b"a", b"\xc4\x9f" * 5, b"x" * 51, b"x" * 52, b"x" * 53, b"x" * 300]
    got = digests.text_md5(b"id|", np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    assert ["".join(f"{x:08x}" for x in r) for r in got.tolist()] == [hashlib.md5(b"id|" + w).hexdigest() for w in words]


def test_tokens_equal_their_pattern():
    rng = random.Random(1)
    letters = list(" \t\n\r\v\f\x1c\x85\xa0aağéİ1٣½.,!́\U0001f600 x中") + [chr(rng.randrange(0x250)) for _ in range(40)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(200)] + [" ", "a", "\n", "."]
    pattern = regex.compile(tokens.TOKEN.replace(r"\s", r" \t-\r"))
    cut = tokens.Cut.of(texts)
    first, n = cut.counts()
    strings = cut.strings().to_pylist()
    for i, t in enumerate(texts):
        here, found = slice(first[i], first[i] + n[i]), list(pattern.finditer(t))
        assert [m.span() for m in found] == list(zip((cut.starts[here] - cut.at[i]).tolist(), (cut.ends[here] - cut.at[i]).tolist(), strict=True))
        assert [m.group() for m in found] == strings[here]
    assert all(5 + int(int(hashlib.md5(f"id|{t}".encode()).hexdigest()[:8], 16) / 2**32 * 31_995) == i for t, i in zip(strings, tokens.RegexTokenizer().together(texts).ids.tolist(), strict=True))


def _calls(run) -> int:
    n = [0]

    def count(frame, event, arg):
        n[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n[0]


@pytest.mark.parametrize("policy", [masked.Offline, masked.Online])
def test_masking_makes_no_calls_for_each_word(policy):
    """Ten times the words in as many windows do not double the calls."""
    rng = random.Random(2)
    tokenizer = tokens.RegexTokenizer()
    rules = policy(masked.Lexicon([("lexicon of", 1.5), ("lexicon", 1.0)]), tokenizer)

    def run(texts):
        found, n = tokens.together(tokenizer, texts)
        state, first = rules.documents(texts, found), np.cumsum(n) - n
        bounds = np.searchsorted(found.words, np.arange(int(found.words[-1]) + 2))
        w = masked.Windows.over(found.words, first, first + n.clip(max=rules.width), [(i, 0) for i in range(len(n))], found.words[first], bounds)
        masked.replaced(rules, tokenizer, w, *rules.select(state, w)[:2], found.ids)

    short, long = (["".join(rng.choice("abcde") * rng.randrange(1, 4) + " " for _ in range(n)) + "lexicon" for _ in range(20)] for n in (50, 500))
    run(short)
    assert _calls(lambda: run(long)) < 2 * _calls(lambda: run(short))


def test_lexicon_words_equal_joined_matches(spark):
    """One pass gives what tokens joined with matches give, and no plan joins them."""
    rng = random.Random(3)
    parts = ["the", "and", "with", "of", " ", " ", "  ", "schein", "tion", ".", "les ", "ğI", "\n", "in the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 200))) for _ in range(60)] + [None, "", " ", "the"]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id int, text string")
    terms = corpus_queries.lexicon_terms(spark)
    joined = masking.word_map(tokens.tokenize(docs), matching.overlapping(docs.select("doc_id", text.search_fold(F.col("text"), unicode=False).alias("norm")), terms))
    want, got = (sorted(map(tuple, x.select("doc_id", "word_id", "priority", "is_phrase").collect())) for x in (joined, masked.lexicon_words(docs, terms)))
    assert got == want and len(want) > 500 and any(r[3] for r in want)
    for name in ("phrase_ranges", "legal_word_map"):
        plan = corpus_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan


def test_texts_reach_python_in_small_batches(spark):
    """Twenty MB of texts in one partition are never in a scan's hands at once."""
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the and "), 640).alias("norm"))
    matching.overlapping(docs, corpus_queries.lexicon_terms(spark))
    seen = [r["n"] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(seen) == 4000 and max(seen) < 1000


def test_padded_batches_hold_every_sample_and_do_not_move_them(spark):
    """Texts that share a doc_id, or have none, keep their own samples; no sample is shuffled."""
    rng = random.Random(4)
    long = [" ".join(rng.choice(["the", "and", "of", "xy"]) for _ in range(n)) for n in (60, 700, 49, 400, 1500, 50)]
    rows = [(i, t) for i, t in enumerate(long)] + [(1, long[1]), (1, long[4]), (None, long[3]), (None, long[3]), (7, None), (8, ""), (9, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = corpus_queries.lexicon_terms(spark)
    samples = [tuple(r) for r in masked.masked_windows(docs, terms, masked.Online).select("doc_id", "chunk", "input_ids", "labels").collect()]
    got = corpus_queries.padded_batches(docs, terms).collect()
    cut = [(r["doc_id"], r["chunk"], r["input_ids"][: r["real"]], r["labels"][: r["real"]]) for r in got]
    left = [s for s in samples]
    for s in cut:
        left.remove(s)
    assert len(got) == len(samples) // 8 * 8 and len(left) == len(samples) % 8
    for b in range(len(got) // 8):
        mine = [r for r in got if r["batch_id"] == b]
        assert len(mine) == 8 and {len(r["input_ids"]) for r in mine} == {len(r["labels"]) for r in mine} == {max(r["real"] for r in mine)}
        assert all(set(r["input_ids"][r["real"] :]) <= {1} and set(r["labels"][r["real"] :]) <= {-100} for r in mine)
    plan = corpus_queries.batch_pad(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_lexicon_build_normalises_once(spark):
    """Parts of a normalised line need no second pass through Python."""
    from corvane.operators import lexicon

    lines = spark.createDataFrame([("ﬁkir ①, ２ ﬃ; Å (é)",), ("a b c d e f g h ﬁ, 'ẛ̣ ﬂ',",), (" ① ﬁ",)], "value string")
    built = lexicon.build(lines, seed=())
    want = [unicodedata.normalize("NFKC", t) for t in ("ﬁkir ①, ２ ﬃ; Å (é", "a b c d e f g h ﬁ", "ẛ̣ ﬂ", "① ﬁ")]
    assert sorted(r["term"] for r in built.collect()) == sorted(want)
    assert built._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
