"""Edge cases and brute-force comparisons of the operators on single texts."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from embergrid.llm import decontaminate, hmm_lm, html_extract, language_id, packing, pii, quality, token_files, url_filter, wordhash

EDGE = [None, "", " ", "\n\n", "one", "a  b", " lead", "trail ", "é ü", "x" * 5000, "w " * 3000]


def frame(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)


def test_word_hashes_follow_the_words():
    texts = ["A b\tc", "", "a  B c ", "ab", "\x0b\x0c", "é É", "b a c"]
    rows = {}
    for first, words, bounds in wordhash.batch_words(pa.array(texts)):
        rows |= {first + i: words[bounds[i] : bounds[i + 1]].tolist() for i in range(len(bounds) - 1)}
    assert rows[0] == rows[2] and rows[1] == rows[4] == [] and sorted(rows[6]) == sorted(rows[0]) and rows[6] != rows[0]
    assert len(rows[3]) == 1 and rows[3][0] not in rows[0] and rows[5][0] != rows[5][1]


@pytest.mark.parametrize("by_join", [False, True])
def test_url_filter(spark, by_join):
    rules = [*url_filter.RULES, ("a.b", "block"), ("a.b/x", "allow"), ("a.b/x/y/", "block"), ("same.c/p", "allow"), ("same.c/p", "block")]
    urls = [None, "", "no scheme", "://", "http://A.B", "http://a.b?q", "https://z.a.b/xq#f", "https://a.b/x/y/z", "https://a.b/x/y", "https://xa.b/x", "http://m.example.com/en/77?x", "http://example.com/en", "http://com/en/", "ftp://q.org/es/1", "http://same.c/pp", "http://a.b:80/x", "http://" + "l." * 500 + "a.b/" + "x" * 3000]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(4, urls[4], "old")], "page_id long, url string, rule string")
    f = url_filter.judge_urls_by_join if by_join else url_filter.judge_urls
    got = sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in f(df, rules).collect()], key=str)

    def brute(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fit = [(h.count("."), len(p), v == "block", r, v) for r, v in rules for h, p in [url_filter.split_rule(r)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[3:] if fit else (None, "allow")))

    assert got == sorted([(i, *brute(u)) for i, u in [*enumerate(urls), (4, urls[4])]], key=str)


@pytest.mark.parametrize("by_join", [False, True])
def test_url_filter_words_of_the_contract(spark, by_join):
    words = {"http://a.com/en/": "block", "http://example.com/en/7": "allow", "http://a.net/de/1": "allow", "http://example.net/de/1": "allow", "http://m.example.net/de/8": "block", "http://a.org/es/": "block", "http://a.org/fr/": "allow"}
    f = url_filter.judge_urls_by_join if by_join else url_filter.judge_urls
    got = f(spark.createDataFrame([(u,) for u in words], "url string"), url_filter.RULES).collect()
    assert {r["url"]: r["verdict"] for r in got} == words


def test_url_filter_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(df, url_filter.RULES).count() == 0


def test_quality_edges(spark):
    texts = [*EDGE, "a b c a b c", "a a a a", "l one\nl one\n\n\nl two", "# * $ % & | < >", " ".join(f"w{i}" for i in range(60))]
    rows = {r["doc_id"]: r for r in quality.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) for d in range(3) if grams[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), i
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.quality(frame(spark, [])).count() == 0


def test_quality_bad_host(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(30)] + [(100 + i, "short", "bad") for i in range(30)] + [(200, good, "bad"), (201, good, None), (202, "x", None)]
    out = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] and not out[200] and out[201] and not out[202]


def test_language_id(spark):
    rng = random.Random(1)
    words = {"aa": ["sol", "luna", "mar", "rio"], "bb": ["wind", "strohm", "achts", "nicht"]}
    rows = [(i, " ".join(rng.choices(words[l], k=rng.choice([1, 5, 30]))), l) for i in range(200) for l in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame([*rows, (900, "sol", None), (901, None, "aa"), (902, "12 34", "bb"), (903, "語 語", None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    out = {r["doc_id"]: r for r in language_id.predict(df.withColumn("score", F.lit("old")), model).collect()}
    assert np.mean([out[i]["lang_pred"] == l for i, _, l in rows]) > 0.99
    assert np.mean([out[i]["rejected"] for i, _, _ in rows]) < 0.02
    assert out[901]["lang_pred"] == out[902]["lang_pred"] == "und" and out[901]["score"] == 0 and out[903]["rejected"]
    long = "sol luna " * 100_000
    assert model.scores(pa.array([long, "sol luna"])).round(6).tolist()[0] == pytest.approx(model.scores(pa.array(["sol luna " * 10]))[0].round(6).tolist(), abs=0.05)
    empty = language_id.train(df.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(df, empty).collect()} == {"und"}


def test_language_pieces_equal_whole_texts(monkeypatch):
    rng = np.random.RandomState(1)
    model = language_id.LanguageModel(["aa", "bb", "cc"], rng.rand(4096, 3), 1.0, 0.0)
    texts = [None, "", "x" * 700, "ab cd " * 200, "é" * 500, "long word " + "q" * 301 + " end", "a"]
    want = model.scores(pa.array(texts))
    for size in (16, 64, 65):
        monkeypatch.setattr(language_id, "BLOCK_BYTES", size)
        assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-12)


def test_language_of_many_kinds_of_rows(spark):
    """More than 256 languages, ids of text, null ids, repeated rows and texts without a space."""
    rows = [(f"id{i}", f"w{i:03d}x " * 30, f"l{i:03d}") for i in range(300)] + [(None, "語" * 5000, "zz")] * 3 + [("id1", "w001x w001x", "l001")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string").withColumns({"judged": F.lit(1), "LETTERED": F.lit(2)})
    spans = language_id.training_spans(df, 10, 2, max_span_chars=50)
    assert spans["lang"].nunique() == 301 and spans["span"].str.len().max() == 50
    assert language_id.training_spans(df, 10, 2, max_languages=1)["lang"].unique().tolist() == ["zz"]
    model = language_id.train(df, epochs=1, n_buckets=1 << 12)
    assert len(model.languages) == 301
    out = language_id.predict(df, model).collect()
    assert len(out) == len(rows) and {r["judged"] for r in out} == {1} and len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] is None}) == 1


def test_language_held_out_accuracy(spark):
    got = language_id.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in got.where("held_out and lang is not null and lang_pred <> 'und'").collect()]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_hmm_matches_enumeration():
    rng = np.random.RandomState(0)
    model = hmm_lm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    texts = [[2, 3, 4, 0], [0], [2, 2, 0], [1, 0]]
    bounds = np.cumsum([0, *map(len, texts)])
    got = hmm_lm.forward(np.concatenate(texts), bounds, model)
    for text, value in zip(texts, got):
        total = 0
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for a, b, s in zip(path, path[1:], text[1:]):
                p *= model.move[a, b] * model.emit[s, b]
            total += p
        assert value == pytest.approx(math.log(total))
    start, moves, emit, loglik = hmm_lm.expected_counts(np.concatenate(texts), bounds, model)
    assert loglik == pytest.approx(got.sum()) and emit.sum() == pytest.approx(bounds[-1])
    assert moves.sum() == pytest.approx(bounds[-1] - len(texts)) and start.sum() == pytest.approx(len(texts))


def test_hmm_base_and_gain(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(v, k=20)) for v in (["a", "b", "c"], ["x", "y", "z"]) for _ in range(60)]
    docs = frame(spark, [*texts, *EDGE, "unseen words A"]).select("doc_id", "text")
    counts, words, model = hmm_lm.train_model(docs, states=2, symbols=4, head=5, rounds=4)
    out = {r["doc_id"]: r for r in hmm_lm.score(docs, counts, words, model, ["doc_id"]).collect()}
    every = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in [*texts, *EDGE, "unseen words A"]]
    c = collections.Counter(w for x in every for w in x)
    n, v = sum(c.values()) + len(every), len(c) + 1
    for i, x in enumerate(every):
        base = sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in [*(c[w] for w in x), len(every)])
        assert out[i]["base_score"] == pytest.approx(base) and out[i]["n_known"] == out[i]["n_tokens"] == len(x) + 1 and out[i]["train_tokens"] == n
    assert sum(out[i]["score"] for i in range(120)) > sum(out[i]["base_score"] for i in range(120))
    assert hmm_lm.score(docs.where("false"), counts, words, model, ["doc_id"]).count() == 0
    c0, w0, m0 = hmm_lm.train_model(docs.where("false"), states=2)
    assert hmm_lm.score(docs.limit(2), c0, w0, m0, ["doc_id"]).count() == 2


def luhn(s):
    d = [int(x) for x in reversed(s)]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pii(spark):
    texts = [*EDGE, "card 4111111111111111, 4111 1111 1111 1111. no 4111111111111112", "on 2024-02-29 or 31.12.1999 or 2023-02-30", "ip 10.0.0.1 not 300.1.1.1 or 1.2.3.4.5", "ssn 123-45-6789 not 000-12-3456", "+1 (017) 555-7713", "me.x1@mail7.example.com", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "4111111111111111"]
    out = {r["doc_id"]: r for r in pii.pseudonymise(frame(spark, texts), "k").collect()}
    for i, t in enumerate(EDGE):
        assert out[i]["text"] == t and out[i]["n_pii"] == 0
    k = len(EDGE)
    card = re.findall(r"\d[\d ]{14,}\d", out[k]["text"])
    assert card[0] == card[1].replace(" ", "") == out[k + 7]["text"] and luhn(card[0]) and card[0] != "4111111111111111" and card[2] == "4111111111111112" and out[k]["n_pii"] == 2
    assert re.fullmatch(r"on \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4} or 2023-02-30", out[k + 1]["text"]) and out[k + 1]["n_pii"] == 2
    assert out[k + 2]["text"].endswith(" not 300.1.1.1 or 1.2.3.4.5") and "10.0.0.1" not in out[k + 2]["text"]
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-\d\d-\d{4} not 000-12-3456", out[k + 3]["text"]) and "123-45" not in out[k + 3]["text"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[k + 4]["text"]) and re.fullmatch(r"[a-z]{2}\.[a-z]\d@[a-z]{4}\d\.[a-z]{7}\.com", out[k + 5]["text"])
    assert re.fullmatch(r'token = "[a-z0-9]{40}"', out[k + 6]["text"]) and "b44e15e0" not in out[k + 6]["text"]
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0
    with pytest.raises(TypeError):
        pii.pseudonymise(frame(spark, []))


def test_pii_links_spellings(spark):
    texts = ["+1 (017) 555-7713", "+1 017 555 7713", "+10175557713", "(017) 555-7713", "017-555-7713", "A.B@x.com", "a.b@X.com", "a.c@x.com", "9" * 32]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)] * 2, "doc_id long, text string, found string, new string, N_PII int")
    rows = pii.pseudonymise(df, "k").collect()
    out = dict((r["doc_id"], r["text"]) for r in rows)
    assert len(rows) == 2 * len(texts) == 2 * len({r["doc_id"] for r in rows}) and {(r["found"], r["new"]) for r in rows} == {("x", "y")}
    digits = [re.sub("[^0-9]", "", out[i]) for i in range(5)]
    assert digits[0] == digits[1] == digits[2] == "1" + digits[3] and digits[3] == digits[4] != "0175557713"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0]) and re.fullmatch(r"\+\d{11}", out[2])
    assert out[5].lower() == out[6].lower() != out[7].lower() and re.fullmatch(r"[A-Z]\.[A-Z]@[a-z]\.com", out[5]) and out[8] != texts[8]


def test_pii_dates_never_meet(spark):
    """Day-first and month-first dates of one year keep apart: no two of them get one string."""
    days = [(d, m) for m in range(1, 13) for d in range(1, 29)]
    texts = [f"{d:02d}/{m:02d}/2021" for d, m in days] + [f"{m:02d}/{d:02d}/2021" for d, m in days if d > 12]
    out = [r["text"] for r in pii.pseudonymise(frame(spark, texts), "k").collect()]
    assert len(set(texts)) == len(texts) == len(set(out))


def test_pii_permutes(spark):
    df = spark.range(1000)
    codes = df.select(pii.permute(F.format_string("%03d", "id"), "k").alias("p"), pii.permute_pair(F.col("id") % 25, F.floor(F.col("id") / 25), (25, 40), "k").alias("q")).collect()
    assert len({r["p"] for r in codes}) == 1000 == len({r["q"] for r in codes}) and all(re.fullmatch(r"\d{3}", r["p"]) for r in codes)


@pytest.mark.parametrize("part_docs, special_as_text", [(3, False), (1000, True)])
def test_token_files_round_trip(spark, tmp_path, part_docs, special_as_text):
    from tokenizers import Tokenizer

    texts = [*EDGE, "Tabs\tand\nlines \n next", "a  b 's don't", "hello <|endoftext|> x", "a b<|endoftext|>", "123 4567, ok?!  two", "\u00a0 wide\u2003 space", *[f"word{i} and more" for i in range(400)]]
    lowest = -(1 << 63)
    rows = [*enumerate(texts), (0, "again"), (None, "no id"), (None, None), (lowest, "lowest id")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, part int, base string").repartition(3)
    folder = f"file://{tmp_path}/out"
    got = token_files.read_tokens(folder, token_files.write_tokens(df, folder, part_docs=part_docs, special_as_text=special_as_text)).orderBy("start").collect()
    plain = Tokenizer.from_file(token_files.default_tokenizer())
    plain.encode_special_tokens = special_as_text
    at, want = 0, collections.Counter()
    assert [r["doc_id"] for r in got] == [None, None, *sorted(i for i, _ in rows if i is not None)]
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_files_of_another_kind_of_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    enc, plain = token_files.BatchEncoder(path), Tokenizer.from_file(path)
    texts = [None, "", "One two  three", " lead", "a<|endoftext|> b"]
    ids, sizes = enc.encode(pa.array(texts))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_token_bases(spark):
    rows = [(i, i % 3, 10 + i) for i in range(25) if i != 7]
    got = token_files.with_bases(spark.createDataFrame(rows, "part int, docs long, tokens long"), block=4).orderBy("part").collect()
    docs = tokens = 0
    for r, (part, d, t) in zip(got, rows, strict=True):
        assert tuple(r) == (part, d, t, docs, tokens)
        docs, tokens = docs + d, tokens + t


def test_token_files_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.read_tokens(folder, token_files.write_tokens(frame(spark, []), folder)).count() == 0


def brute_pack(items, capacity):
    bins, out = [], []
    for doc_id, length, source, cluster in items:
        piece = 0
        while length > capacity:
            out.append((doc_id, piece, len(bins), 0, capacity))
            bins.append([capacity, {("full", len(bins))}])
            piece, length = piece + 1, length - capacity
        tags = {x for x in (("s", source), ("c", cluster)) if x[1] is not None}
        fits = [(capacity - used, k) for k, (used, held) in enumerate(bins) if capacity - used >= length and not held & tags and not any(h[0] == "full" for h in held)]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, set()])
        out.append((doc_id, piece, k, bins[k][0], length))
        bins[k][0] += length
        bins[k][1] |= tags
    return out


def test_packing_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([1, 3, 7, 15, 31, 70]), rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, "p", f"u{i}"])) for i in range(400)]
    items.sort(key=lambda x: -x[1])
    assert packing.pack_items(items, 32) == brute_pack(items, 32)
    df = spark.createDataFrame(items + [(None, 1, None, None), (5, 3, "a", None)], "doc_id long, length long, source string, cluster string").repartition(3)
    rows = packing.pack(df, 32, 64).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(x[1] for x in items) + 4
    held = collections.defaultdict(list)
    by_id = {x[0]: x for x in items}
    for r in rows:
        held[r["bin_id"]].append(r)
    for own in held.values():
        assert sum(r["n_tokens"] for r in own) <= 32
        sources = [by_id[r["doc_id"]][2] for r in own if r["doc_id"] is not None and by_id[r["doc_id"]][2]]
        assert len(sources) == len(set(sources))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, packing.pack(df.repartition(1), 32, 64).collect()), key=str)
    assert packing.pack_documents(frame(spark, EDGE)).count() >= len(EDGE) and packing.pack_documents(frame(spark, [])).count() == 0


def test_packed_tokens_decode_to_the_documents(spark):
    from tokenizers import Tokenizer

    texts = [*EDGE, *[f"some {'more ' * (i % 40)}words {i}" for i in range(80)]]
    rows = [(i % 70, t, f"s{i % 30}") for i, t in enumerate(texts)] + [(None, "no id, no source", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "cluster": F.lit("same")}).repartition(3)
    placed = packing.pack_tokens(df, 64, 32)
    plain = Tokenizer.from_file(token_files.default_tokenizer())
    got = collections.Counter()
    for r in packing.sequences(placed).collect():
        assert len(r["ids"]) <= 64 and len(r["doc_ids"]) == len(r["starts"]) == len(r["pieces"])
        for k, (doc_id, start, piece) in enumerate(zip(r["doc_ids"], r["starts"], r["pieces"])):
            end = [*r["starts"], len(r["ids"])][k + 1]
            if end - start == 64 or piece:
                continue
            assert r["ids"][end - 1] == token_files.END_ID
            got[doc_id, plain.decode(r["ids"][start : end - 1])] += 1
    whole = collections.Counter((d, t or "") for d, t, _ in rows if len(plain.encode(t or "").ids) < 63)
    assert got == whole and sum(r["n_tokens"] for r in placed.collect()) == sum(len(plain.encode(t or "").ids) + 1 for _, t, _ in rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in placed.collect()) and packing.pack_tokens(df.where("false")).count() == 0


def test_packing_keeps_given_clusters_apart(spark):
    df = spark.createDataFrame([(i, f"text {i}", None) for i in range(40)], "doc_id long, text string, source string")
    clusters = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (None, 1)], "doc_id long, cluster long")
    rows = packing.pack_documents(df, 30, 100, clusters).collect()
    held = collections.defaultdict(list)
    for r in rows:
        held[r["bin_id"]].append(r["doc_id"])
    assert len(rows) == 40 and all(len({d % 2 for d in own if d < 30}) == sum(d < 30 for d in own) for own in held.values())


def test_html_extract(spark):
    page = """<html><head><title>T</title><script>if (a < b) {}</script></head><body><nav><a>Menu</a></nav><div class="sidebar">side</div>
    <article><header>by me</header><h1>Head &amp; line</h1><p>First, a   paragraph<br>of text.<p>Second &#233;. <aside>no</aside> Done.</p>
    <div class="comments"><p>Nice, great post!</p></div><form><p>Sign, up.</p></form><!-- x --><div class="loads">kept, too.</div></article><footer>foot</footer>"""
    want = "Head & line First, a paragraph of text. Second é. Done. kept, too."
    pages = [page, None, "", "plain text only.", "<p>cut off <b>here</b> <a href='x", "<div><p>No article, but text, all right.</p><p>More, of it.</p></div><div class='footer'>f</div>"]
    df = spark.createDataFrame([(i, "u", h, "old") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert out[0]["text"] == want and out[0]["n_chars"] == len(want)
    assert [out[i]["text"] for i in range(1, 6)] == ["", "", "plain text only.", "cut off here", "No article, but text, all right. More, of it."]
    assert html_extract.extract(df.where("false")).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        last, row[0] = row[0], i + 1
        for j, b in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (a != b), row[j] + 1, row[j + 1] + 1)
    return min((d, j) for j, d in enumerate(row))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([9, 20, 40])))) for i in range(8)] + [(98, None), (99, " \n"), (100, "Short  q"), (None, "no, id"), (101, "w")]
    texts = [*EDGE]
    for _ in range(60):
        own = list(rng.choice(items[:8])[1])
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            own[rng.randrange(len(own))] = rng.choice(["", "z", "yy"])
        texts.append(" ".join(rng.choices(words, k=10)) + " " + "".join(own).upper() + "\n" + " ".join(rng.choices(words, k=10)))
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = {}
    for i, t in enumerate(texts):
        for j, item in items[:8]:
            d, _ = distance(decontaminate.normal(item), decontaminate.normal(t or ""))
            if d <= int(decontaminate.BUDGET * len(item)):
                want[i, j] = d
    whole = {100: "short q", None: "no, id", 101: "w"}
    texts += ["SHORT Q", "a short\tq, and", "short quite", "ashort q", "No, id!", "no, ids", "say w."]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(frame(spark, texts).withColumn("k", F.lit(1)), bench, ["doc_id"], block_chars=100).collect()}
    for i, t in enumerate(texts):
        for j, item in whole.items():
            if re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", decontaminate.normal(t or "")):
                want[i, j] = 0
    assert got == want and len(want) > 30 and sum(j in whole for _, j in want) == 4 + 1
    clean = [r["doc_id"] for r in decontaminate.without_matches(frame(spark, texts), bench, block_chars=100).collect()]
    assert sorted(clean) == [i for i in range(len(texts)) if i not in {i for i, _ in want}]
    twice = spark.createDataFrame([(None, "a short q", 1, 2), (None, "a short q", 1, 2), (None, None, 1, 2), (4, "x " * 60_000 + "no, id", 1, 2)], "m long, text string, `__m` int, k int")
    found = decontaminate.matches(twice, bench, ["m", "__m", "k"]).collect()
    assert [tuple(r)[:4] for r in found] == [(None, 1, 2, 100)] * 2 + [(4, 1, 2, None)] and decontaminate.without_matches(twice, bench).count() == 1
    assert decontaminate.without_matches(twice, bench.where("false")).count() == 4
    with pytest.raises(ValueError):
        decontaminate.matches(frame(spark, []).withColumn("distance", F.lit(1)), bench, ["distance"])
    assert decontaminate.matches(frame(spark, texts), spark.createDataFrame([], "item_id long, text string"), ["doc_id"]).count() == 0


def test_permutations_by_format(spark):
    """All strings of small formats: each format is mapped onto itself, one to one, and not as it is."""
    from embergrid.llm import pii

    for alphabet, own in ((None, ("0123456789", "0123456789", "0123456789")), (None, ("abcdefghijklmnopqrstuvwxyz", "0123456789")), (pii.LOWER, (pii.LOWER, pii.LOWER, "0123456789abcdef"[:16])), (pii.UPPER, (pii.UPPER, pii.UPPER))):
        every = ["".join(x) for x in itertools.product(*own)]
        got = [r[0] for r in spark.createDataFrame([(x,) for x in every], "s string").select(pii.permute(F.col("s"), "k", alphabet)).collect()]
        assert sorted(got) == sorted(every) and sum(a == b for a, b in zip(got, every)) < len(every) / 8


def test_hexadecimal_secrets_stay_hexadecimal(spark):
    from embergrid.llm import pii

    secrets = ["deadbeefdeadbeefdeadbeefdeadbeef", "d3adbeef" * 5, "D3ADBEEF" * 8, "ABCDEFABCDEFABCDEFABCDEFABCDEFABCDEF", "0123456789" * 4]
    texts = [f"my {x}" for x in secrets] + [f"token={secrets[1]} and {secrets[1]}", "a" * 31, "z" * 40, "word " * 100_000 + secrets[0], "dead " * 40]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "k").orderBy("doc_id").collect()
    new = [r["text"].split()[-1] for r in rows]
    for old, x in zip(secrets, new):
        assert x != old and re.fullmatch("[0-9a-f]+" if old.lower() == old and not old.isdigit() else "[0-9A-F]+" if not old.isdigit() else "[0-9]+", x) and len(x) == len(old)
    assert [r["n_pii"] for r in rows] == [1, 1, 1, 1, 1, 2, 0, 0, 1, 0]
    assert new[8] == new[0] and rows[5]["text"] == f"token={new[1]} and {new[1]}"
    again = pii.pseudonymise(spark.createDataFrame([(0, rows[0]["text"])], "doc_id int, text string"), "k").first()
    assert again["n_pii"] == 1
