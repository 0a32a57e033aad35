"""Scores, scans, filters, mixing and tokens against plain recomputation."""

import base64
import gzip
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from airloom.llm import bpe, license_scan, lm_score, mixing, quality, secrets, url_filter
from airloom.llm.queries import RANKS, URL_RULES

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def held(doc_id, modulus):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def test_scores_from_exact_counts(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    train = Counter()
    for r in rows:
        if held(r["doc_id"], 7) != 2:
            train.update([*lm_score.words_of(r["text"] or ""), b""])
    n, v = sum(train.values()), len(train)
    found = lm_score.score_texts(odd_docs).collect()
    assert len(found) == len(rows)

    def expected(text):
        tokens = [*lm_score.words_of(text or ""), b""]
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens)
        return len(tokens), sum(train[t] > 0 for t in tokens), round(base, 4)

    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in found)
    want = Counter()
    for r in rows:
        want[(r["doc_id"], held(r["doc_id"], 7) == 2, *expected(r["text"]))] += 1
    assert got == want and {r["train_tokens"] for r in found} == {n}
    assert all(r["score"] <= 0 for r in found)
    assert lm_score.score_texts(no_docs).count() == 0


def test_scores_follow_the_counts(spark, folder):
    """The filter's probabilities against those of exact counts, on all given texts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    single, pairs = Counter(), Counter()
    for r in rows:
        if held(r["doc_id"], 7) != 2:
            tokens = [lm_score.START, *lm_score.words_of(r["text"]), b""]
            single.update(tokens)
            pairs.update(zip(tokens, tokens[1:]))
    starts = single[lm_score.START]
    n, v = sum(single.values()) - starts, len(single) - 1
    found = {r["doc_id"]: r for r in lm_score.score_texts(docs).collect()}
    gap = whole = 0.0
    for r in rows:
        tokens = [lm_score.START, *lm_score.words_of(r["text"]), b""]
        exact = sum(math.log10((pairs[a, b] + 50 * (single[b] + 1) / (n + v + 1)) / (single[a] + 50)) for a, b in zip(tokens, tokens[1:]))
        assert found[r["doc_id"]]["score"] == pytest.approx(exact, abs=2 + 0.15 * len(tokens))  # levels and false positives
        gap += found[r["doc_id"]]["score"] - exact
        whole += exact
    assert abs(gap) < 0.06 * abs(whole)
    assert sum(r["score"] for r in found.values() if r["held_out"]) > sum(r["base_score"] for r in found.values() if r["held_out"])


def test_filter_holds_every_count():
    draw = np.random.default_rng(4)
    keys = draw.integers(0, 2**63, 5_000).astype(np.uint64)
    counts = np.minimum(draw.zipf(1.5, 5_000), 10**6)
    bits, events = lm_score._shard_bits(keys, counts, 1 << 40)
    model = lm_score.CountFilter(bits, np.array([0]), np.array([8 * len(bits)]))
    got = model.counts(keys)
    assert (got >= np.where(counts == 1, 1, counts * 0.7)).all()
    assert (np.abs(got - counts) <= 0.5 * counts + 1).mean() > 0.95
    others = draw.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (model.counts(others) > 0).mean() < 0.02


KEY = "AKIA" + "Q7" * 10
HEX = "0123456789abcdef" * 2


@pytest.mark.parametrize("text,base", [
    ("", []),
    ("password=hunter22 x", [("assign", 0, 17)]),
    ("API_KEY : 'abcdef' Token=abc", [("assign", 0, 17)]),
    ("password: token: abcdefg", []),
    ("\u017fecret=abcdefgh", []),
    (f"é {KEY}.", [("access", 2, 26)]),
    ("AKIA" + "X" * 15, []),
    (f"token={HEX}", [("assign", 0, 38), ("hex", 6, 38)]),
    ("f" * 23, []),
])
def test_base_spans(text, base):
    found, more, _, oversize = secrets.scan(text)
    assert found == base and not more and not oversize


def coded(text, *ways):
    for way in ways:
        if way == "url":
            text = "".join(f"%{b:02X}" for b in text.encode())
        elif way == "unicode":
            text = "".join(f"\\u{ord(c):04x}" for c in text)
        elif way == "base64":
            text = base64.b64encode(text.encode()).decode()
        else:
            pack = gzip.compress if way == "gzip" else zlib.compress
            text = base64.b64encode(pack(text.encode())).decode()
    return text


@pytest.mark.parametrize("ways", [("url",), ("unicode",), ("base64",), ("gzip",), ("zlib",), ("url", "url"), ("base64", "url"),
                                  ("unicode", "base64"), ("gzip", "unicode"), ("base64", "base64", "base64"), ("zlib", "url", "base64")])
def test_nested_layers_map_back(ways):
    hidden = coded(f"my key is {KEY} and more", *ways)
    text = f"ü before {hidden} after"
    base, more, layers, _ = secrets.scan(text)
    start = text.index(hidden)
    assert base == [] and layers > 1
    assert [s for s in more if s[0] == "access"], ways
    for kind, a, b in more:
        assert start <= a < b <= start + len(hidden)


def test_a_key_before_a_coded_value():
    value = "".join(f"%{b:02x}" for b in b"hunter2hunter2")
    text = f"say password={value} now"
    base, more, _, _ = secrets.scan(text)
    assert base == [] and more == {("assign", 4, 4 + 9 + len(value))}


def test_layers_end_and_keep_base_spans():
    text = f"token={KEY} %2525252541 {coded('password=abcdefgh', 'base64')}"
    base, more, layers, _ = secrets.scan(text)
    assert base == secrets.find_spans(text) and layers < 50 and ("assign", 0, 30) in base


@pytest.mark.parametrize("before", ["", "\u00a0", "\u200b", "\ufeff", "\f"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_layers_of_any_characters(before, pack):
    for raw in (f"{before} so {KEY} {before}".encode(), f"{before} so {KEY} ".encode() + b"\xff"):
        text = "x " + base64.b64encode(pack(raw)).decode() + " y"
        assert [s[0] for s in secrets.scan(text)[1]] == ["access"]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("pack", [bytes, zlib.compress])
def test_wrapped_runs_are_one(end, pack):
    coded = base64.b64encode(pack(f"some words {'and more ' * 5} {KEY} {HEX} tail".encode())).decode()
    lines = end.join(coded[i:i + 76] for i in range(0, len(coded), 76))
    kinds = {s[0] for s in secrets.scan(f"key:\n{lines}\nend of it")[1]}
    assert kinds == {"access", "hex"}


@pytest.mark.parametrize("before", ["data/", "a_", "-", "x", "xy", "xyz", "\\n", "/a/bc/"])
def test_runs_glued_to_what_precedes_them(before):
    hidden = base64.b64encode(f"so {KEY} it is".encode()).decode()
    assert [s[0] for s in secrets.scan(f"see {before}{hidden} there")[1]] == ["access"]


def test_oversize_layers_are_counted(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_BYTES", 1_000)
    assert secrets.scan("x " + coded("a" * 5_000, "zlib"))[3] == 1


def test_secrets_of_odd_rows(odd_docs, no_docs, spark):
    rows = secrets.scan_secrets(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["spans"] for r in rows} == {""}
    assert secrets.scan_secrets(no_docs).count() == 0
    some = spark.createDataFrame([(1, f"a token={HEX} {KEY}")], "doc_id long, text string")
    row = secrets.scan_secrets(some).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 1, 1)
    assert row["base"] == row["spans"] == "assign:2:40,hex:8:40,access:41:65"


def test_licenses(spark, odd_docs, no_docs):
    filler = " ".join(f"w{i}" for i in range(300))
    full = license_scan.NOTICES["bsd-conditions"]
    texts = [f"{filler} {license_scan.NOTICES['mit']} {filler}", full, full.replace("binary", "octal"), f"{filler}\n{full.upper()}",
             filler, " ".join(full.split()[:9]), f"{license_scan.NOTICES['mit']} {full} {license_scan.NOTICES['apache-2.0']}", None, ""]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n long, template_id string")
    templates = license_scan.notices(spark)
    found = {(r["doc_id"], r["template_id"]): r for r in license_scan.scan_licenses(docs, templates).collect()}

    def runs(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    expected = {(i, name) for i, t in enumerate(texts) for name, notice in license_scan.NOTICES.items()
                if len(runs(t) & runs(notice)) >= 0.8 * len(runs(notice))}
    assert set(found) == expected and (0, "mit") in expected and (2, "bsd-conditions") not in expected
    assert found[0, "mit"]["first_word"] == 300 and found[0, "mit"]["last_word"] == 304 and found[1, "bsd-conditions"]["containment"] == 1
    assert license_scan.scan_licenses(odd_docs, templates).count() == 0
    assert license_scan.scan_licenses(no_docs, templates).count() == 0
    assert license_scan.scan_licenses(docs, templates.where("false")).count() == 0


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.ORG/es/1?ref=x#a", "http://example.org/en/12", "http://a.org", "http://a.org/",
        "http://xorg/", "https://m.x.com/fr/1", "https://x.com/de/", "ftp://b.net/p/?a=1&utm_source=z", "http://b.net/p?a=1#t", "http://b.net/p?a=2",
        "http://c.net/#?x", "http://c.net", "x://y://z/w"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(None, "http://c.net", "r"), (15, "http://c.net", "r")],
                                  "page_id long, url string, rule string")
    listed = spark.createDataFrame([("http://www.b.net/p/?a=1",), ("q://C.net/",), (None,), ("junk",), ("http://c.net",)], "url string")
    found = url_filter.filter_urls(pages, listed, URL_RULES, blocks=8).collect()
    assert len(found) == len(URLS) + 2
    verdicts = {URLS[r["page_id"]]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found if r["page_id"] is not None}
    assert verdicts == {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        URLS[4]: ("www.example.org", "/es/1", "example.org/es/", "block"), URLS[5]: ("example.org", "/en/12", "example.org/en/1", "block"),
        URLS[6]: ("a.org", "", None, "allow"), URLS[7]: ("a.org", "/", "org/", "allow"), URLS[8]: ("xorg", "/", None, "allow"),
        URLS[9]: ("m.x.com", "/fr/1", "com/fr/", "allow"), URLS[10]: ("x.com", "/de/", "com/de/", "block"),
        URLS[11]: ("b.net", "/p/", None, "block"), URLS[12]: ("b.net", "/p", None, "block"), URLS[13]: ("b.net", "/p", None, "allow"),
        URLS[14]: ("c.net", "/", None, "block"), URLS[15]: ("c.net", "", None, "block"), URLS[16]: ("y:", "//z/w", None, "allow")}
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.where("false"), []).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.where("false"), listed, URL_RULES).count() == 0


def test_bloom_filter_misses_nothing(spark):
    listed = spark.range(5_000).select(F.concat(F.lit("u"), "id").alias("canon"))
    blocks = url_filter.bloom_blocks(listed, blocks=1 << 10)
    inside = " AND ".join(f"w{w} & m{w} = m{w}" for w in range(url_filter.WORDS))

    def passing(rows):
        probed = rows.select("canon", url_filter._block(F.col("canon"), 1 << 10).alias("block"),
                             *[m.alias(f"m{w}") for w, m in enumerate(url_filter._masks(F.col("canon")))])
        return probed.join(blocks, "block").where(inside).count()

    assert passing(listed) == 5_000
    assert passing(spark.range(5_000).select(F.concat(F.lit("v"), "id").alias("canon"))) < 100


def test_quality_on_held_out_labels(spark, folder):
    big = folder.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id")
    right = scored.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert kept.join(labels.where("quality = 1"), "doc_id").count() > 0.98 * labels.where("quality = 1").count()


def test_repeated_lines_move_their_statistic():
    at = quality.STATISTICS.index("same_lines")
    assert quality.statistics("one line\nanother\none line\none line")[at] == 0.5
    assert quality.statistics("one line\n\nanother\n\nthird\n")[at] == 0 and quality.statistics(r"a\n a\n a")[at] == 0


def test_quality_of_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (5, None), (None, 0), (6, 7), (9, 0), (7, 1)], "doc_id long, quality int")
    rows = quality.score_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score_quality(odd_docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(no_docs, labels).count() == 0
    assert quality.drop_low_quality(odd_docs, labels.where("quality = 1")).count() == odd_docs.count()


def test_isotonic_pools_violators():
    assert quality.isotonic(np.array([0.0, 1, 0, 2]), np.array([1.0, 1, 1, 1])).tolist() == [0, 0.5, 0.5, 2]


def test_features_approximate_a_gaussian_kernel():
    size = len(quality.STATISTICS)
    model = quality.QualityModel(np.zeros(size), np.ones(size), np.zeros(1), np.zeros(1), np.zeros(1), 0.5, True)
    x = np.random.default_rng(1).normal(0, 0.5, (50, size))
    made = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / quality.WIDTH**2)
    assert np.abs(made @ made.T - exact).max() < 0.35


def test_mixing_meets_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).where("doc_id % 2 = 0")
    targets = {"en": 4.0, "fr": 3.0, "de": 2.0, "es": 1.0}
    rows = mixing.mix(docs, labelled, targets).toPandas()
    posterior = np.array(rows["posterior"].tolist())
    assert np.allclose(posterior.sum(1), 1) and (rows["rate"] >= 0).all() and len(rows) == docs.count()
    totals = (posterior * (rows["rate"] * rows["n_tokens"]).to_numpy()[:, None]).sum(0)
    assert totals / rows["n_tokens"].sum() == pytest.approx([0.4, 0.3, 0.2, 0.1], rel=0.02)
    lang = docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    assert (np.array(list(targets))[posterior.argmax(1)] == lang.loc[rows["doc_id"]].to_numpy()).mean() > 0.95
    more = mixing.repeat_to_targets(docs, labelled, targets)
    assert more.columns == docs.columns and more.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("few", [0.01, 0.001])
def test_mixing_reaches_targets_of_domains_that_are_nearly_absent(spark, few):
    """Against the exact solution for documents whose domain is certain: one rate per domain."""
    draw = np.random.default_rng(4)
    kinds = {"aa": "abcde", "bb": "mnopq"}
    docs = [(i, d, " ".join("".join(draw.choice(list(kinds[d]), 6)) for _ in range(200)))
            for i, d in enumerate(["bb"] * max(1, int(2_000 * few)) + ["aa"] * int(2_000 * (1 - few)))]
    frame = spark.createDataFrame(docs, "doc_id long, domain string, text string").repartition(4).cache()
    targets = {"aa": 0.88, "bb": 0.12}
    rows = mixing.mix(frame, frame.select("doc_id", "domain"), targets)
    shares = {r["domain"]: r["share"] for r in mixing.reached_shares(rows, list(targets)).collect()}
    assert shares["bb"] == pytest.approx(0.12, rel=0.01) and sum(shares.values()) == pytest.approx(1)
    lone = rows.select("posterior", "n_tokens", "rate").toPandas()
    sure = np.array(lone["posterior"].tolist())[:, 1] > 0.999
    assert lone["rate"][sure].to_numpy() == pytest.approx(0.12 * lone["n_tokens"].sum() / lone["n_tokens"][sure].sum(), rel=0.02)


def test_rates_minimise_what_they_should(spark):
    """Soft memberships, against plain projected gradient on all rates at once."""
    draw = np.random.default_rng(6)
    p = draw.dirichlet([0.4, 0.3, 0.2], 300)
    n = draw.integers(1, 500, 300).astype(float)
    members = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(n, p))], "doc_id long, n_tokens long, posterior array<double>")
    shares = np.array([0.2, 0.3, 0.5])
    pulls, step = mixing.fit_rates(members, shares)
    found = mixing._rates(p, pulls, step, 0.0)
    goal, scale = shares * n.sum(), ((p * n[:, None]).T @ p).diagonal()

    def errors(rate):
        return (p * (n * rate)[:, None]).sum(0) - goal

    def cost(rate):
        return (np.square(errors(rate)) / scale).sum() + mixing.PULL * (n * np.square(rate - 1)).sum()

    rate = np.ones(300)
    for _ in range(5_000):
        rate = np.maximum(0.0, rate - 0.2 * (p @ (errors(rate) / scale) + mixing.PULL * (rate - 1)))
    assert len(pulls) < 60 and (found >= 0).all()
    assert cost(found) < cost(np.ones(300)) / 100 and cost(found) == pytest.approx(cost(rate), rel=0.1)
    assert np.allclose(errors(found) / goal, 0, atol=0.01)


def test_mixing_of_odd_rows(odd_docs, no_docs):
    labelled = odd_docs.where("doc_id is not null").select("doc_id", F.col("lang").alias("domain")).distinct()
    rows = mixing.mix(odd_docs, labelled, {"en": 0.5, "de": 0.5}).collect()
    assert len(rows) == odd_docs.count() and all(r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in rows)
    assert mixing.mix(no_docs, labelled, {"en": 1.0}).count() == 0
    assert mixing.repeat_to_targets(odd_docs, labelled.where("false"), {"en": 0.5, "de": 0.5}).count() >= odd_docs.count()
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, labelled, {"en": 1.0, "de": 0.0})


def test_every_character_is_split_like_the_library(library):
    vocabulary, split = bpe.vocabulary_of(PATH), bpe.splitter(public_tokenizers.PATTERN)
    text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0))
    ids = []
    for piece in split(text):
        found = vocabulary.whole([piece.encode()])[0]
        ids += vocabulary.merged(piece.encode()) if found is None else [found]
    assert ids == library.encode_ordinary(text)
    assert vocabulary.decode(np.array(ids)) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [f"key {i}".encode() for i in range(5_000)]
    made, slots = bpe.PerfectHash.build(keys)
    assert sorted(slots.tolist()) == list(range(5_000)) and made.size == 5_000


@pytest.mark.parametrize("piece", ["a" * 3_000, "thhesheth" * 50, "東京" * 300, "é", " xq"])
def test_merges(library, piece):
    assert bpe.vocabulary_of(PATH).merged(piece.encode()) == library.encode_ordinary(piece)


def test_tokens_of_odd_rows(odd_docs, no_docs, library):
    made = bpe.decode(bpe.encode(odd_docs, PATH, public_tokenizers.PATTERN), PATH)
    rows = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in made.collect())
    expected = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in odd_docs.collect())
    assert rows == expected
    assert bpe.decode(bpe.encode(no_docs, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_token_digests(spark, folder, library):
    from airloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, folder).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
