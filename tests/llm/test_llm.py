"""The ten operators and the pipeline: known cases, brute-force versions, odd inputs."""

import hashlib
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import arrow, bpe_automaton, cotraining, embeddings, exact_dedup, hosts, jaccard, langid, packing, pii, queries, shingles, warc
from corvane.operators import skew
from corvane.storage import materialize

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "Same Text here now"), (5, "same text HERE now"), (5, "same text HERE now"), (None, "same text here now"), (7, "x" * 200_000), (8, "one two three four five six " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("token", F.lit("clash")).withColumn("sid", F.lit(0)).withColumn("score", F.lit(0)).withColumn("n", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_langid_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_langid_segments_and_batches_agree(docs):
    model = langid.fit(docs)
    data = np.frombuffer(("Der schöne Tag. " * 9000).encode(), np.uint8)
    whole = langid.code_lengths(model, data, np.array([0, len(data)]))
    old, langid.SEGMENT = langid.SEGMENT, 1000
    try:
        assert (langid.code_lengths(model, data, np.array([0, len(data)])) == whole).all()
    finally:
        langid.SEGMENT = old
    texts = [b"abc def", b"", b"le chat", b"x"]
    flat, cuts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    single = [langid.code_lengths(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert (langid.code_lengths(model, flat, cuts) == np.array(single)).all()


WORDS = {
    "de": "der die und nicht schön Straße über mit ein ist wir für", "en": "the and of that with this from have which would their",
    "es": "el la que los mañana niño pero como muy está año", "fr": "le les des était où même très été garçon leur",
    "it": "il che della più perché città sono questa anche gli", "nl": "het een van niet zijn voor maar ook werd deze",
    "pl": "się jest nie że łódź które może więc być tego", "pt": "não uma são coração também ção mais então pelo",
    "tr": "ve bir için değil çok şu ğ ışık olan karar", "el": "και το δεν που είναι από στην με για αυτό",
    "ja": "これ は です 日本 の 言語 と ある 人 から", "ru": "и не что это как его было для они все",
}


def brute_bits(samples: list[bytes], order: int, text: bytes) -> float:
    """Plain PPM: dictionaries of contexts, method C without exclusions; ``None`` stands before the start."""
    seen: dict = {}
    for s in samples:
        line = [None] * order + list(s)
        for i in range(order, len(line)):
            for k in range(order + 1):
                followers = seen.setdefault(tuple(line[i - k : i]), {})
                followers[line[i]] = followers.get(line[i], 0) + 1
    line, bits = [None] * order + list(text), 0.0
    for i in range(order, len(line)):
        for k in range(order, -1, -1):
            followers = seen.get(tuple(line[i - k : i]))
            if not followers:
                continue
            total = sum(followers.values()) + len(followers)
            if line[i] in followers:
                bits -= np.log2(followers[line[i]] / total)
                break
            bits -= np.log2(len(followers) / total)
        else:
            bits += 8
    return bits


def test_langid_of_twelve_languages_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang].split(), n))
    train = [(i, text(k, 30), k) for i, k in enumerate(list(WORDS) * 5)]
    probe = [text(k, 6) for k in WORDS] + ["zzz \x00 ÿ 漢字", "x", "Ωmega"]
    for order in (2, 4):
        model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), order=order)
        assert model.order == order and model.langs == tuple(sorted(WORDS))
        raw = [t.encode() for t in probe]
        got = langid.code_lengths(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])) / langid.FRACTION
        want = [[brute_bits([t.encode() for _, t, k in train if k == lang], order, t) for lang in model.langs] for t in raw]
        assert np.allclose(got, want, rtol=0, atol=1e-4)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(probe)], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(rows, model).collect()}
    assert [found[i] for i in range(12)] == list(WORDS)


def test_langid_odd(odd):
    got = [r["lang_pred"] for r in langid.predict(odd.select("doc_id", "text"), langid.fit(odd)).collect()]
    assert got.count("und") == 3
    assert [r["lang_pred"] for r in langid.predict(odd.select("doc_id", "text"), langid.fit(odd.limit(0))).collect()] == ["und"] * len(ODD)


def test_quality_accuracy_and_odd(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op2_quality(spark, sf).join(labels, "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.97
    assert [r["score"] for r in cotraining.classify(odd, labels.limit(0)).collect()] == [1.0] * len(ODD)
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    pages = spark.createDataFrame([(1, "http://a.b/en/4"), (2, None), (None, "x://c/en/4/")], "page_id long, url string")
    got = cotraining.classify(odd, some, pages).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert cotraining.classify(odd.limit(0), some, pages.limit(0)).count() == 0


def _two_views(spark, n=3000, seed=6):
    """Texts and sources that each tell good from bad, independently; few labels."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.7
    source = [f"{'g' if (g if rng.random() < 0.93 else not g) else 'b'}{rng.integers(0, 12)}" for g in good]
    nouns = {True: "river mountain garden letter window music teacher harbour".split(), False: "casino bonus winner jackpot crypto viagra deal click".split()}
    text = [" ".join(rng.choice(nouns[bool(g if rng.random() < 0.85 else not g)]) for _ in range(12)) for g in good]
    docs = spark.createDataFrame([(i, t, s, "en") for i, (t, s) in enumerate(zip(text, source, strict=True))], "doc_id long, text string, source string, lang string")
    return docs, spark.createDataFrame([(i, int(good[i])) for i in range(45)], "doc_id long, quality int"), good


def test_each_view_learns_from_the_other(spark):
    docs, labels, good = _two_views(spark)
    rows = cotraining.features(docs)
    right = {}
    for rounds in (0, 4):
        got = cotraining.score(rows, cotraining.fit(rows, labels, rounds=rounds)).collect()
        right[rounds] = {c: np.mean([(r[c] >= 0.5) == good[r["key"]] for r in got]) for c in ("text_score", "meta_score", "score")}
    assert right[4]["text_score"] > right[0]["text_score"] + 0.01 and right[4]["meta_score"] > right[0]["meta_score"] + 0.01
    assert right[4]["score"] > 0.95 and right[4]["score"] >= max(right[4]["text_score"], right[4]["meta_score"]) - 0.01


def test_exchange_equals_brute_force(spark):
    """The rounds' gifts, recounted row by row over the whole feature table."""
    docs, labels, _ = _two_views(spark)
    rows = cotraining.features(docs)
    model = cotraining.fit(rows, labels, rounds=3)
    table = rows.join(labels, "doc_id", "left_anti").toPandas()
    x = {"text": np.stack(table["t"]).astype(np.float64), "meta": np.stack(table["m"])}
    left = np.ones(len(table), bool)
    assert len(model.rounds) == 3 and all(w >= 0 for w in model.combined[1:])
    for r in model.rounds:
        given = np.zeros(len(table), bool)
        for view, gifts in r.gifts.items():
            z = r.views[view].logit(x[view])
            cells = np.clip(np.rint((z + 20) * 100), 0, 4000)
            bad, fine = z[left] <= gifts.low, z[left] >= gifts.high
            quota = {"bad": 0.1 * left.sum(), "fine": 0.1 * left.sum()}
            for some, name in ((bad, "bad"), (fine, "fine")):  # at most its share of the pool, unless one cell alone holds more
                assert some.sum() <= quota[name] or len(set(cells[left][some])) == 1
            assert np.isinf(gifts.low) or (bad.any() and fine.any())
        for labels_of in r.labels(x).values():
            given |= labels_of >= 0
        assert given[left].any()
        left &= ~given


def test_hosts(spark):
    urls = [(1, "https://A.Example.COM/en/71?x"), (2, "http://b.example.net/de/8#y"), (3, None), (4, "no scheme"), (5, "ftp://net/de/1"), (5, "x://xnet/de/"), (6, "a://h.org?/es/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(71, 0, None), (71, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = [tuple(r)[:5] for r in hosts.judge_pages(pages, labels, hosts.parse_rules(queries.RULES)).collect()]
    assert sorted(got, key=str) == sorted([(1, "a.example.com", "/en/71", "example.com/en/7", "allow"), (2, "b.example.net", "/de/8", "example.net/de/8", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "net", "/de/1", "net/de/", "allow"), (5, "xnet", "/de/", None, "allow"), (6, "h.org", "", None, "allow")], key=str)
    bad = hosts.reputation(spark.createDataFrame([("bad.example.com", 400, 396), ("ok.example.com", 400, 4), ("new.example.com", 0, 0)], "host string, n long, k long")).collect()
    assert {r["host"]: r["low"] > 0.4 for r in bad} == {"bad.example.com": True, "ok.example.com": False, "new.example.com": False}
    assert hosts.judge_pages(pages.limit(0), labels.limit(0), ()).count() == 0


def test_host_levels(spark):
    names = {"a.b.example.co.uk:8080": ("co.uk", "example.co.uk"), "bob:pw@x.github.io": ("github.io", "x.github.io"), "example.com.": ("com", "example.com"), "com": ("com", "com"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "x" * 5000 + ".org": ("org", "x" * 5000 + ".org")}
    rows = spark.createDataFrame([(n,) for n in names], "host string").select("host", hosts.suffix_of(F.col("host")).alias("s"), hosts.domain_of(F.col("host")).alias("d")).collect()
    assert {r["host"]: (r["s"], r["d"]) for r in rows} == names


def test_hosts_block_by_reputation(spark, monkeypatch):
    """A table in which one domain's pages are bad, whose new host is blocked with them; a hot clean host, odd columns, very long urls."""
    monkeypatch.setattr(skew, "MOST_HOT", 4)
    urls = [(i, f"http://h{i % 4}.bad.co.uk:80/en/{i}") for i in range(200)] + [(i, f"https://hot.fine.co.uk/en/{i}?x") for i in range(200, 800)] + [(i, f"http://s{i % 9}.example.org/de/{i}") for i in range(800, 1000)]
    urls += [(1000, "http://new.bad.co.uk/about"), (1001, "http://new.fine.co.uk/x"), (1002, "http://" + "y" * 100_000 + ".org/"), (None, None), (None, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rate", F.lit(0)).withColumn("pages", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i >= 200 or i % 10 == 0), 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    got = hosts.judge_pages(pages, labels, ()).collect()
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert len(got) == len(urls) and all(verdict[i] == ("block" if i < 200 else "allow") for i in range(1000))
    assert (verdict[1000], verdict[1001], verdict[1002], verdict[None]) == ("block", "allow", "allow", "allow")


def test_exact_dedup_collisions_and_odd(odd):
    for hash128 in (exact_dedup.md5, lambda text: F.lit(b"same")):
        for keep, best, short in (("min", 4, 1), ("max", 5, 2)):  # rows that repeat id and text: one stays
            got = exact_dedup.exact_groups(odd, keep=keep, hash128=hash128).collect()
            same = [r for r in got if r["group_size"] == 4]
            assert len(got) == len(ODD) and len(same) == 4 and {r["keep_id"] for r in same} == {best} and [r["doc_id"] for r in same if r["kept"]] == [best]
            assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2)} == {short}
    nobody = exact_dedup.exact_groups(odd.where("doc_id is null").unionAll(odd.where("doc_id is null"))).collect()
    assert [r["keep_id"] for r in nobody] == [None, None] and sum(r["kept"] for r in nobody) == 1
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_exact_dedup_hot_text(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT", 4)
    rows = [(i, "Hot" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), keep="max").collect()}
    same: dict = {}
    for i, t in rows:
        same.setdefault(t, []).append(i)
    assert all(got[i]["keep_id"] == max(same[t]) and got[i]["group_size"] == len(same[t]) and got[i]["kept"] == (i == max(same[t])) and got[i]["text_sha256"] == hashlib.sha256(t.lower().encode()).hexdigest() for i, t in rows)


def test_bpe_equals_the_library(docs, odd):
    from tokenizers import Tokenizer

    extra = ["\u1c89 \ua7cb\ua7dc \U00010d50 X", "Σίσυφος ΟΔΟΣ", "a<|endoftext|>B", "\x1c\x1d a\u0085b", "İ ﬁ ½ Ⅷ", "aaaaaaaaaaaaaaaa", "don't I'LL"]
    texts = [r["text"] for r in docs.limit(40).collect()] + extra + [t or "" for _, t in ODD]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        ours, theirs = bpe_automaton.compile_tokenizer(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        for text, (ids, decoded) in zip(texts, ours.encode_batch(texts), strict=True):
            want = theirs.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and decoded == theirs.decode(want, skip_special_tokens=False)
    got = bpe_automaton.encode_documents(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == len(ODD) and [r["n_tokens"] for r in got][:3] == [0, 0, 0]


def test_warc_round_trip(spark):
    rows = [(1, "http://b.org/x", "<p>é</p>"), (2, "http://a.org/", "<p>é</p>"), (3, None, None), (4, "u\r\nv://q", ""), (None, "http://c.org", "z"), (9, "http://a.org/", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages.repartition(5), archive_bytes=200)
    got = warc.read_archives(warc.merge_index(manifest, range_records=2, fan_in=2), with_payload=True).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [(0, "response", None, 1), (1, "response", None, 9), (2, "revisit", 1, 9), (3, "response", None, 0), (4, "revisit", 3, 0), (9, "revisit", 1, 9)]
    assert {r["payload_digest"] for r in got if r["page_id"] in (1, 2, 9)} == {warc.payload_digest("<p>é</p>".encode())}
    order = [(r["url_key"], r["captured"]) for r in sorted(got, key=lambda r: (r["key_range"], r["position"]))]
    assert order == sorted(order)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_order_over_many_passes(spark):
    """All pages of a table: many ranges, four passes, odd rows and clashing columns; order and records as a sort gives them."""
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    rows = [tuple(r) for r in table] + [(10**9 + i, None if i % 2 else "http://dup.org/", "same" if i % 3 else "") for i in range(40)] + [(2 * 10**9, "http://long.org/", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash")).withColumn("sha1", F.lit(1)).withColumn("first", F.lit(2))
    manifest = warc.write_archives(pages.repartition(6), archive_bytes=1500)
    assert manifest.count() > 27
    got = warc.read_archives(warc.merge_index(manifest, range_records=10, fan_in=3), with_payload=True, archives=manifest.count()).collect()
    assert len({r["key_range"] for r in got}) >= 3 and len(got) == len(rows)
    in_order = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(got, key=lambda r: (r["key_range"], r["position"]))]
    assert in_order == sorted(in_order) and [k for k, *_ in in_order] == sorted(warc.url_key(u) for _, u, _ in rows)
    first: dict = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    text = {i: h or "" for i, _, h in rows}
    for r in got:
        h = text[r["page_id"]]
        revisit = first[h] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(h.encode()), warc.payload_digest(h.encode()), "revisit" if revisit else "response", first[h] if revisit else None)
        assert r["payload"] == (None if revisit else h.encode())


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in range(9):
        runs = [sorted(rng.integers(0, 9, rng.integers(0, 6)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def brute_components(texts: dict, k: int, percent: int) -> tuple[dict, dict]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    component = {i: i for i in texts}
    changed = True
    links = [(i, j) for i in texts for j in texts if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(component[i], component[j])
            if component[i] != low or component[j] != low:
                component[i] = component[j] = low
                changed = True
    return {i: len(s) for i, s in sets.items()}, component


@pytest.mark.parametrize("words,percent,heavy,paired", [(4, 85, 64, 64), (5, 80, 64, 64), (4, 85, 2, 2), (2, 70, 3, 4)])
def test_jaccard_equals_brute_force(spark, docs, words, percent, heavy, paired, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(1)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(60).collect()}
    base = [f"w{i}" for i in range(120)]
    for i in range(60):  # near copies of one text, and small sets
        copy = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            copy[at] = f"z{rng.integers(0, 9)}"
        texts[10_000 + i] = " ".join(copy)
        texts[20_000 + i] = " ".join(f"s{j}" for j in range(rng.integers(1, 16)))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = jaccard.near_duplicates(frame, words=words, percent=percent, heavy_from=heavy).collect()
    sizes, component = brute_components(texts, words, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_jaccard_sets_that_share_half_an_id(spark, docs, monkeypatch):
    whole = jaccard.set_id
    monkeypatch.setattr(jaccard, "set_id", lambda s: (whole(s)[0] % 5, whole(s)[1]))
    texts = {r["doc_id"]: r["text"] for r in docs.limit(60).collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes, component = brute_components(texts, 4, 85)
    got = jaccard.near_duplicates(frame, words=4, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], component[i]) for i in texts}


def common_phrases(n: int = 90) -> dict:
    """Documents of their own words, each with two of a few phrases that many share; and one near copy."""
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(n):
        own = [f"w{i}x{j}" for j in range(120)]
        for at, phrase in zip((20, 80), rng.integers(0, 6, 2), strict=True):
            own[at : at + 8] = [f"p{phrase}q{j}" for j in range(8)]
        texts[i] = " ".join(own)
    return texts | {n: texts[0] + " more"}


def test_jaccard_chance_makes_no_cluster(spark, monkeypatch):
    """What many documents share by chance stays heavy in large tables, where the number of heavy shingles is bounded."""
    met = []
    within = jaccard._within_clusters
    monkeypatch.setattr(jaccard, "_within_clusters", lambda clusters, *rest: met.append(clusters.count()) or within(clusters, *rest))
    monkeypatch.setattr(jaccard, "MOST_PAIRED", 8)
    monkeypatch.setattr(jaccard, "MOST_HEAVY", 40)
    texts = common_phrases()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = jaccard.near_duplicates(frame, words=4, percent=85, heavy_from=8).collect()
    sizes, component = brute_components(texts, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], component[i]) for i in texts}
    assert component[90] == 0 and met == [0]


def test_jaccard_more_heavy_shingles_than_are_broadcast(spark, monkeypatch):
    met = []
    within = jaccard._within_clusters
    monkeypatch.setattr(jaccard, "_within_clusters", lambda clusters, *rest: met.append(clusters.count()) or within(clusters, *rest))
    monkeypatch.setattr(jaccard, "MOST_PAIRED", 4)
    monkeypatch.setattr(jaccard, "MOST_HEAVY", 1)
    texts = common_phrases()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = jaccard.near_duplicates(frame, words=4, percent=85, heavy_from=4).collect()
    sizes, component = brute_components(texts, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], component[i]) for i in texts}
    assert met == [0]


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = disk.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    table = materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "t")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 100


def test_jaccard_odd(odd):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] == 5} == {4}
    assert {r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_embeddings_recall_and_odd(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(200, 16))
    x = (centres[rng.integers(0, 200, 3000)] + 0.15 * rng.normal(size=(3000, 16))).astype(np.float32)
    label = rng.integers(0, 2, 3000)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, rows[0][1], None), (5004, [1.0], 0), (5005, [None] * 16, 0), (5006, rows[0][1], rows[0][2]), (5007, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, cell_size=20, block=64).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    want = links.sum(1) - 1 + (links[:, 0])
    found = np.array([got[i]["n_links"] for i in range(3000)])
    assert (found <= want).all() and found.sum() / want.sum() > 0.9
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (5000, 5001, 5002, 5003, 5004, 5005, 5007))
    assert got[5006]["n_links"] == want[0] and got[5006]["component_id"] == got[0]["component_id"]
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("cell_size", [2, 20, 10_000])
def test_embeddings_miss_no_link_at_any_number_of_cells(spark, cell_size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x[2000:] = x[:2000] + 0.35 * rng.normal(size=(2000, 64))  # pairs on both sides of the threshold, in no clusters
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, cell_size=cell_size).collect()}
    linked = unit @ unit.T >= 0.93
    want, component = linked.sum(1) - 1, np.arange(4000)
    while (lower := np.where(linked, component[None], 4000).min(1)).tolist() != component.tolist():
        component = lower
    assert want.sum() > 1000 and [got[i]["n_links"] for i in range(4000)] == want.tolist()
    assert [got[i]["component_id"] for i in range(4000)] == component.tolist() and all(got[i]["kept"] == (component[i] == i) for i in range(4000))


def test_embeddings_of_any_size_repeated_and_without_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT", 4)
    rows = [(1, [1e200, 0.0], 1), (2, [1e200, 0.0], 1), (3, [1e-200, 0.0], 1), (4, [0.0, 5e-324], 1), (None, [3.0, 0.0], 1), (None, [0.0, 1.0], 2), (5, [1e308, 1e308], 3), (5, [1e308, 1e308], 3), (6, None, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("clash")).withColumn("links", F.lit(0)).withColumn("norm", F.lit(0))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True), (None, 0, None, False), (None, 3, 1, False)]
    assert got == sorted(want, key=str)


def test_packing(spark, odd, docs):
    for table in (odd, docs):
        rows = packing.pack_documents(table, public_tokenizers.path("byte_bpe_50k.json"), group=40).collect()
        bins: dict = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in bins.values():
            pieces.sort()
            assert sum(n for _, n in pieces) <= 1024 and all(o == sum(n for _, n in pieces[:i]) for i, (o, _) in enumerate(pieces))
    pieces = materialize(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    assert packing.bound(pieces) <= len(bins) <= 1.02 * packing.bound(pieces) + 1
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.pack_documents(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    long = ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" + "\t \u3000" * 2000 + "é<|endoftext|>" + " " * 5000, "q" * 100_000, "!" * 20_000]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + long + [t or "" for _, t in ODD]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, group=40).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*theirs.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for p, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, p] = (s, n, zlib.crc32(ids[s : s + n].tobytes()))
    assert got == want and len(rows) == len(want)


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(1, 60, rng.integers(1, 40))
        bins, _ = packing.best_fit_decreasing(sizes, 60)
        assert packing.lower_bound(np.bincount(sizes, minlength=61), 60) <= bins.max() + 1
    assert packing.lower_bound(np.bincount([31, 31, 31], minlength=61), 60) == 3


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> dict:
    out: dict = {k: [] for k in PATTERNS}
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out[kind].append((m.start(), m.end()))
    return out


def test_pii_equals_patterns(docs, odd):
    rng = np.random.default_rng(3)
    texts = [r["text"] for r in docs.collect()] + ["".join(rng.choice(list("0123456789..+@@a--  ()b%é"), rng.integers(0, 60))) for _ in range(8000)]
    for text in texts:
        found = pii.find(text)
        assert {k: found[k] for k in pii.BASE} == brute_spans(text)
    assert pii.mask("mail a@b.co now") == "mail <email> now" and pii.mask(None) is None
    found = pii.find("IBAN: DE89 3704 0044 0532 0130 00, SSN 123-45-6789; ftp://bob:pw@host.org/ account no. 12345678")
    assert [len(found[k]) for k in ("iban", "ssn", "userinfo", "account")] == [1, 1, 1, 1]
    assert len(pii.find_spans(odd).collect()) == len(ODD)
    for text, kind, n in (("pay DE89 3704 0044 0532 0130 00 now", "iban", 1), ("NL91ABNA0417164300.", "iban", 1), ("xDE89370400440532013000", "iban", 0), ("DE88 3704 0044 0532 0130 00", "iban", 0), ("SE20 some words that go on and on", "iban", 0), ("Acct 12345678", "account", 1), ("ACCT: 12345", "account", 0), ("Ssn 123-45-6789", "ssn", 1), ("ssn 000-45-6789", "ssn", 0), ("ftp://bob@host", "userinfo", 0)):
        assert len(pii.find(text)[kind]) == n, text


def test_pii_query_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_pii(spark, SF).collect():
        spans = brute_spans(docs[r["doc_id"]] or "")
        base = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in spans[k])
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(spans[k]) for k in PATTERNS] and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_pipeline_against_brute_force(spark, docs):
    """Each stage on its own input."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = materialize(corpus_pipeline.quality(spark, docs, SF), "t")
    want = {r["doc_id"] for r in cotraining.classify(docs, labels, spark.read.parquet(f"{SF}/pages.parquet")).collect() if r["score"] >= 0.5}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == corpus_pipeline.COLUMNS
    two = materialize(corpus_pipeline.exact(spark, one, SF), "t")
    first: dict = {}
    for r in sorted(one.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(r["text"].translate({c: c + 32 for c in range(65, 91)}), r["doc_id"])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(first.values())
    three = materialize(corpus_pipeline.near(spark, two, SF), "t")
    _, component = brute_components({r["doc_id"]: r["text"] for r in two.collect()}, 5, 80)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(component.values()))
    four = materialize(corpus_pipeline.personal(spark, three, SF), "t")
    assert four.schema == three.schema
    assert not any(brute_spans(r["text"])["email"] for r in four.collect()) and all(r["n_chars"] == len(r["text"]) for r in four.collect())
    five = corpus_pipeline.pack(spark, four, SF)
    assert {r["doc_id"] for r in five.select("doc_id").collect()} == {r["doc_id"] for r in four.collect()}


def test_pipeline_odd(spark, odd):
    """Rows that repeat ids, texts or both; null, empty and very long texts; clashing columns."""
    rows = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES}
    same = {(4, "Same Text here now"), (5, "same text HERE now"), (None, "same text here now")}
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    once = [(1, None), (3, "  \n "), (4, "Same Text here now"), ODD[7], ODD[8]]
    assert texts(rows["exact"]) == sorted(once, key=str)
    assert texts(rows["near"]) == sorted([x for x in ODD if x not in same] + [(4, "Same Text here now")], key=str)
    assert texts(rows["pii"]) == sorted(ODD, key=str) and all(df.columns == corpus_pipeline.COLUMNS for name, df in rows.items() if name != "pack")
    assert {r["doc_id"] for r in rows["quality"].collect()} <= {i for i, _ in ODD}
    assert rows["pack"].where("piece = 0").count() == len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_pipeline_ids_that_repeat(spark):
    rows = [(1, "same"), (2, "same"), (2, "other unique text"), (3, "dup"), (3, "dup"), (3, "a b c d e f g h"), (9, "a b c d e f g h"), (9, "alone in the world of words")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    want = sorted([(1, "same"), (2, "other unique text"), (3, "dup"), (3, "a b c d e f g h"), (9, "alone in the world of words")])
    assert kept(corpus_pipeline.exact(spark, docs, SF)) == want
    assert kept(corpus_pipeline.near(spark, docs, SF)) == want


def test_pipeline_batches_are_small(spark):
    """Whole texts reach a Python worker about a megabyte at a time."""
    texts = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    arrow.bound_batches(spark)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    got = texts.mapInArrow(run, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 64 and max(r["size"] for r in got) < 1.5 * (1 << 20)


def test_shingles_hash_in_small_memory(monkeypatch):
    """What a worker holds while it hashes does not depend on the batch, and where segments end changes no hash."""
    data = np.frombuffer(b"some words of a document " * 160_000, np.uint8)
    offsets = np.arange(0, len(data) + 1, 4000)
    monkeypatch.setattr(shingles, "_POWERS", shingles._Powers())
    tracemalloc.start()
    try:
        words = sum(len(w) for w in shingles.words_of(data, offsets))
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words == 800_000 and held < 24e6, held
    whole = np.array([0, len(data) // 4])
    want = [w.tolist() for w in shingles.words_of(data, whole)]
    monkeypatch.setattr(shingles, "SEGMENT", 1000)
    assert [w.tolist() for w in shingles.words_of(data, whole)] == want


def test_quality_fits_in_small_memory(monkeypatch):
    """The driver holds a block of a fit's rows as floating-point numbers, and blocks change no weight beyond rounding."""
    draw = np.random.default_rng(0)
    x = draw.random((20_000, cotraining.TEXT_FEATURES))
    y = (x[:, 0] + 0.3 * draw.random(len(x)) > 0.6).astype(float)
    tracemalloc.start()
    try:
        got = cotraining.Additive.fit(x, y, np.ones(len(x)), False)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 50e6, held
    monkeypatch.setattr(cotraining, "NEWTON_ROWS", len(x))
    assert np.abs(cotraining.Additive.fit(x, y, np.ones(len(x)), False).weights - got.weights).max() < 1e-9
