"""Each operator against a brute-force version, an exact round trip or held-out labels, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crawlframe.llm import bpe, common, fingerprint, html_text, jaccard, language, mixing, passages, quality, urlfilter, vectors
from crawlframe.llm.graph import components
from crawlframe.llm.words import raw_words, shingles

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def odd_documents() -> list[tuple]:
    base, other = prose(1, 300), prose(2, 300)
    near = [*base[:150], "changed", *base[151:]]
    mixed = [*other[:100], *base[100:170], *other[100:]]
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", " \n\t ", "one", "two words", "THREE small Words", "three small words",
             " ".join(other), " ".join(mixed), "a " * 400, "a " * 399, "9 8 7 !!", " ".join(prose(3, 20_000)), "é ü ñ", " ".join(base)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i == 3 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, " ".join(base), "en", "s1", 5)]


def brute_components(rows: list[tuple], k: int, percent: int) -> dict[int, int]:
    sets = {i: set(shingles(t, k).tolist()) for i, t, *_ in rows if i is not None}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and low[b] < low[a] and 100 * len(x & y) >= percent * len(x | y):
                    low[a], changed = low[b], True
    return low


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows with extra columns whose names operators might use themselves."""
    return spark.createDataFrame(odd_documents(), DOCS).withColumns({"id": F.lit(1), "n": F.lit("x"), "score": F.lit(2.0), "src": F.lit("z")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, 1_000), (1_000, 250)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 250: 250, 300: 250, 1_000: 250}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_documents(spark, docs, k, percent):
    got = jaccard.near_documents(docs, k, percent).collect()
    want = brute_components(odd_documents(), k, percent)
    assert len(got) == len(odd_documents())
    assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)
    assert {r["n_shingles"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}


def test_near_documents_group_of_copies(spark):
    """Hundreds of edited copies of one text, exact copies among them, and a frequent line in unrelated texts."""
    r, base, rows = random.Random(4), prose(9, 120), []
    for i in range(300):
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(1_000 + i, " ".join([*base[:12], *prose(100 + i, 40)])) for i in range(100)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)


@pytest.mark.parametrize("n", [0, 1, 300, 3_000, 20_000])
def test_sketches_fold_and_bound_the_difference(n):
    """A folded sketch is the one of fewer buckets, and no sketch tells more differences than there are."""
    r = np.random.default_rng(n)
    a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[n // 20:], r.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))
    one, two = jaccard.sketch(a), jaccard.sketch(b)
    for words in {16, 64, min(len(one), len(two))}:
        x, y = jaccard.folded(one, words), jaccard.folded(two, words)
        if len(x) == len(y) == words:
            buckets = np.bincount((a % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
            assert (np.packbits(buckets.astype(np.uint8)).view(np.int64) == x).all()
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, {"s0": 3.0, "s1": 1.0}, epochs=4.0)
    assert got.columns == [*docs.columns, "copy", "mix_key"]
    rows = got.collect()
    assert not [r for r in rows if r["source"] == "s2"]
    rates = {r["src"]: r for r in mixing.source_rates(docs, {"s0": 3.0, "s1": 1.0}, 4.0).collect()}
    total = sum(r["mass"] for r in rates.values())
    assert rates["s0"]["rate"] * rates["s0"]["mass"] == pytest.approx(3 * total)
    for i in {r["doc_id"] for r in rows} - {None}:
        u = int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16) / 2**52
        mine = [r for r in rows if r["doc_id"] == i]
        cdf = rates[mine[0]["source"] or ""]["cdf"]
        times = sum(c <= u for c in cdf)
        assert len(mine) == times * sum(x[0] == i for x in odd_documents())
    assert mixing.mix(empty).count() == 0


def test_html():
    page = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav>Menu <a href=x>one</a></nav>"
            "<div class='cookie-notice'>We use cookies, accept, please</div><div id=main><h2>Head &amp; line</h2>"
            "<p>Some text, with commas, and\n more text that is long enough.<p>Second&nbsp;para <a href=y>link</a> tail &alpha;."
            "<div class=ad>Buy, buy, buy now, really, now</div></div><div class=comments><p>Great, great, wow, long comment, indeed, more.</p></div>"
            "<footer>&copy; x</footer></body>")
    want = "Head & line\nSome text, with commas, and more text that is long enough.\nSecond para link tail α."
    assert html_text.extract(page) == want
    assert html_text.extract(page[:-60]) == want
    assert [html_text.extract(x) for x in (None, "", "plain  text", "<p>a<p>b <b>c", "<!-- open", "x < y")] == ["", "", "plain text", "a\nb c", "", "x < y"]
    assert html_text.extract("<div>" * 3_000 + "<p>deep, text</p>") == "deep, text"


def test_html_names_do_not_hide_the_article():
    story = "<p>Some text, with commas, and more text that is long enough.</p><p>More, and more, and more text of the story.</p>"
    want = "Some text, with commas, and more text that is long enough.\nMore, and more, and more text of the story."
    for start, end in (("<div id='main' class='content has-sidebar'>", "</div>"), ("<div class='post-body no-comments'>", "</div>"),
                       ("<div class='entry-content hidden-print'>", "</div>"), ("<form action=x><div>", "</div></form>"),
                       ("<div class='sidebar-layout'><article>", "</article></div>"), ("<div class='side'>", "</div>")):
        assert html_text.extract(f"<body><nav>Menu</nav>{start}{story}{end}<div class=ad><p>Buy, now</p></div></body>") == want
    thread = "".join(f"<article class=comment-body><p>Great, great, long comment {i}, indeed.</p></article>" for i in range(9))
    assert html_text.extract(f"<body><div class=story>{story}</div><div id=comments class=comments>{thread}</div></body>") == want
    assert html_text.extract(f"<body><div hidden>{story}</div><p>Seen, text.</p></body>") == "Seen, text."


def test_html_query(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a, b</p>", 0), (1, "u", "<p>a, b</p>", 0), (None, None, None, 1)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_text.extract_text(rows).collect()), key=str) == [(1, "u", "a, b", 4), (1, "u", "a, b", 4), (None, None, "", 0)]


def test_url_rules(spark):
    urls = ["http://A.example.ORG/es/1", "https://example.org/en/17?x", "http://x.org/", "http://x.org", "ftp://b.com/fr/1", "http://com/de/1",
            "http://xcom/de/1", "no scheme", None, "", "http://q.net/en/1?a=1&b=2#f", "://"]
    got = urlfilter.judge(spark.createDataFrame([(i, u, "e") for i, u in enumerate(urls)] * 2, "page_id long, url string, label string"))
    rows = sorted(set(map(tuple, got.select("page_id", "host", "path", "rule").collect())))
    assert rows == [
        (0, "a.example.org", "/es/1", "example.org/es/"), (1, "example.org", "/en/17", "example.org/en/1"), (2, "x.org", "/", "org/"),
        (3, "x.org", "", None), (4, "b.com", "/fr/1", "com/fr/"), (5, "com", "/de/1", "com/de/"), (6, "xcom", "/de/1", None),
        (7, "", "", None), (8, "", "", None), (9, "", "", None), (10, "q.net", "/en/1", None), (11, "", "", None)]
    assert {r["verdict"] for r in got.collect()} <= {"allow", "block"} and got.count() == 24
    same = urlfilter.judge(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string"))
    assert [tuple(r)[3:5] for r in same.collect()] == [(None, "allow")]


def test_passages(spark, docs):
    base, other = prose(1, 300), odd_documents()[11][1].split()
    other_words = raw_words(odd_documents()[10][1])
    found = [tuple(r) for r in passages.repeated_passages(docs).collect()]
    assert (11, 100, 170, 0, 100, 170, 70) in found and base[100:170] == other[100:170]
    assert any(r[0] == 1 and r[1] == 0 and r[2] == 300 and r[6] >= 299 for r in found)
    assert not {r[0] for r in found} & {0, 3, 4, 5, 6, 7, 10, 15, None}
    kept = passages.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert after[2] == "" and after[0] == odd_documents()[0][1] and after[3] is None
    assert after[11] == "" and raw_words(after[10]) == other_words  # both parts of 11 are in earlier documents


def covered(found: list, rows: list[tuple]) -> bool:
    """Whether every run of 50 words that an earlier text holds lies inside one of the passages."""
    first, spans = {}, {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["word_from"], r["word_to"]))
    for i, t in sorted(rows):
        words = raw_words(t)
        for at in range(len(words) - 49):
            run = tuple(words[at:at + 50])
            if first.setdefault(run, i) != i and not any(lo <= at and at + 50 <= hi for lo, hi in spans.get(i, ())):
                return False
    return True


def test_passages_behind_stock_phrases(spark):
    """A passage whose seeds lie in still earlier documents that share less than 50 words."""
    rows = []
    for g in range(10):
        p, at = prose(500 + g, 60), 10 * g
        parts = [p[:35], p[26:], p, p]
        rows += [(at + i, " ".join([*prose(600 + at + i, 40), *x, *prose(800 + at + i, 40)])) for i, x in enumerate(parts)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} >= {(10 * g + 3, 10 * g + 2) for g in range(10)}
    assert covered(found, rows)


@pytest.mark.parametrize("once,often", [(1, 70), (5, 13), (3, 40)])
def test_passages_repeated_in_one_document(once, often):
    """Every copy in the later document is found, however many there are."""
    p = prose(50, 60)
    text = lambda n, seed: [w for i in range(n) for w in [*prose(seed + i, 30), *p]]
    a, b = text(once, 1_000), text(often, 2_000)
    found = passages.aligned(*(passages.word_hashes(" ".join(x)) for x in (a, b)))
    assert all(any(b0 <= at and at + 60 <= b1 for _, _, b0, b1, _ in found) for at in range(30, len(b), 90))


def edited(words: list[str], share: float, seed: int) -> list[str]:
    """The words with that share of them replaced, at random places."""
    r = random.Random(seed)
    at = set(r.sample(range(len(words)), int(share * len(words) + 1e-9)))
    return [f"x{seed}-{i}" if i in at else w for i, w in enumerate(words)]


@pytest.mark.parametrize("n,share,least", [(60, 0.05, 0.95), (60, 0.1, 0.9), (60, 0.15, 0.8), (100, 0.1, 0.95), (100, 0.2, 0.9)])
def test_recall_of_edited_passages(n, share, least):
    """Pairs that brute force (one subsequence over the whole passage) finds at 0.8."""
    hit = total = 0
    for i in range(60):
        p = prose(7_000 + i, n)
        q = edited(p, share, i)
        hp, hq = (passages.word_hashes(" ".join(x)) for x in (p, q))
        assert passages.common_words(hp, hq) >= 0.8 * n
        a, b = ([*prose(k + i, 50), *x, *prose(k + 500 + i, 50)] for k, x in ((10_000, p), (20_000, q)))
        found = passages.aligned(*(passages.word_hashes(" ".join(x)) for x in (a, b)))
        total += 1
        hit += any(min(b1, 50 + n) - max(b0, 50) >= 0.8 * n for _, _, b0, b1, _ in found)
    assert hit >= least * total


def test_edited_passages_in_the_query(spark):
    rows = []
    for i in range(40):
        p = prose(30_000 + i, 80)
        rows += [(2 * i + k, " ".join([*prose(40_000 + 2 * i + k, 40), *x, *prose(50_000 + 2 * i + k, 40)])) for k, x in enumerate((p, edited(p, 0.1, i)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["doc_id"] for r in found if r["source_id"] == r["doc_id"] - 1 and r["n_same"] >= 0.8 * (r["word_to"] - r["word_from"])}) >= 38


def test_chaining_scores_the_best_order():
    r = np.random.default_rng(0)
    for _ in range(30):
        pts = np.unique(r.integers(0, 60, (14, 2)), axis=0)
        y, x = pts[:, 0], pts[:, 1]
        best = passages.chains(x, y)[0]
        value = lambda c: sum(passages.SEED for _ in c) - passages.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:], strict=False))  # noqa: E731, B023
        top = [float(passages.SEED)] * len(x)
        for i in range(len(x)):
            for j in range(i):
                if x[j] < x[i] and y[j] < y[i]:
                    top[i] = max(top[i], passages.SEED + top[j] - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]))
        assert value(best) == pytest.approx(max(top))


def test_fingerprints(spark):
    texts = ["a b.c\nd e.\nf", "f\na b.c\nd e.", "a b.c\nd e.", "f", "", None, "x. " * 5_000]
    df = fingerprint.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "p")
    fp = {r["doc_id"]: (r["p_wide"], r["p_fine"]) for r in df.collect()}
    assert fp[0] == fp[1] != fp[2] and fp[4] == fp[5]
    pair = spark.createDataFrame([(*fp[2], *fp[3])], "a array<long>, b array<int>, c array<long>, d array<int>")
    plus = pair.select(*fingerprint.combine(*(F.col(c) for c in "abcd"))).first()
    assert tuple(plus) == fp[0]
    back = spark.createDataFrame([(*fp[0], *fp[3])], "a array<long>, b array<int>, c array<long>, d array<int>")
    assert tuple(back.select(*fingerprint.combine(*(F.col(c) for c in "abcd"), sign=-1)).first()) == fp[2]


def test_fingerprint_query(spark):
    docs = sorted(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    rows = {r["doc_id"]: r for r in fingerprint.op6_fingerprint(spark, SMALL).collect()}
    for k, (i, t) in enumerate(docs):
        m, following = len(t) // 4, docs[(k + 1) % len(docs)][1]
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - m] + following[:m]).encode()).hexdigest()
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_edited"] <= 1
    assert np.median([r["near_edited"] for r in rows.values()]) > 0.4 > np.quantile([r["near_next"] for r in rows.values()], 0.9)


def test_next_row(spark):
    rows = [(5, "b", 1), (None, "n", 2), (5, "a", 3), (-7, "c", 4)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string, extra int"), ["text"])
    assert {(r["doc_id"], r["text"]): r["next_text"] for r in got.collect()} == {(None, "n"): "c", (-7, "c"): "a", (5, "a"): "b", (5, "b"): "n"}
    one = fingerprint.with_next(spark.createDataFrame([(1, "x")], "doc_id long, text string"), ["text"])
    assert [r["next_text"] for r in one.collect()] == ["x"]


def test_embeddings(spark):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(12):
        mid = r.standard_normal(24)
        for _ in range(12):
            rows.append((n, (mid + r.standard_normal(24) * 0.27).astype(np.float32).tolist(), g % 3 if g else None))
            n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [float("inf")] * 24, 1), (n + 4, [], 1),
             (n + 5, [1.0, None], 1), (n + 6, [1.0, 0.0], 1), (n + 7, [2.0, 0.0], 1), (None, rows[15][1], 1), rows[20]]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()
    good = {i: (np.array(v, np.float64), lb) for i, v, lb in rows if i is not None and v and None not in v and lb is not None}
    near = {i: set() for i, *_ in rows}
    for i, (x, a) in good.items():
        for j, (y, b) in good.items():
            with np.errstate(all="ignore"):
                if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    near[i].add(j)
    low = {i: i for i in near if i is not None}
    for _ in range(len(low)):
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in low}
    assert len(got) == len(rows) and sum(map(len, near.values())) > 50
    for x in got:
        i = x["vec_id"]
        assert (x["n_links"], x["component_id"], x["kept"]) == ((0, None, False) if i is None else (len(near[i]), low[i], low[i] == i))


def test_language(spark, docs, empty):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op8_language(spark, "/root/testdata/sf0.01").join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got) > 100
    model = language.train(rows)
    odd = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (3, 4, 5, 14))
    assert language.train(empty).predict("words") == ("und", 0.0)
    assert language.keep_known(docs, model, 0.5).columns == docs.columns


def test_quality():
    texts = [" ".join(prose(i, 30)) for i in range(60)]
    noisy = [t.replace(" ", "### ") for t in texts]
    net = quality.fit(texts + noisy, np.array([1] * 60 + [0] * 60), epochs=4)
    fresh = [" ".join(prose(1_000 + i, 40)) for i in range(30)]
    assert (net.score(fresh) >= 0.5).all() and (net.score([t.replace(" ", "### ") for t in fresh]) < 0.5).all()
    whole = net.score([None, "", fresh[0], "x" * 300_000, fresh[0]])
    assert ((whole >= 0) & (whole <= 1)).all() and whole[[2, 0]] == pytest.approx(whole[[4, 1]], rel=1e-5)
    assert net.score([fresh[0]])[0] == pytest.approx(whole[2], rel=1e-6)
    assert quality.fit([], np.array([])).score(["a"]).shape == (1,)


def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, content = Tokenizer.from_file(path), bpe.load_vocabulary(path)
    texts = [t or "" for _, t, *_ in odd_documents()] + [
        "\x1c a\x1c", "ΑΣ ΟΔΟΣ", "it's I'LL don't 123 ½ ²", "<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|> x", "é É", "👍🏽 日本語",
        "a" * 500, "İ ſ ẞ", "\x00 \x85z", "a​b", "'s's't", "Ａ　Ｂ"]
    mine = bpe.Codec(content)
    for t, codes in zip(texts, mine.encode(texts), strict=True):
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert memoryview(codes).cast("I").tolist() == ids
        assert mine.decode(codes) == theirs.decode(ids, skip_special_tokens=False)
    rows = bpe.decode(bpe.encode(docs, content), content).collect()
    assert len(rows) == len(odd_documents()) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)


def test_first_pairs_of_many_words():
    """The first pairs of all words come from one table; merged together, words get the codes that each gets by itself."""
    import public_tokenizers

    codec = bpe.Codec(bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    right = [*codec.inner, *codec.last]
    for a, b in [*np.random.default_rng(9).integers(0, (256, 512), (300, 2)).tolist(), [116, 104], [116, 256 + 104], [101, 256 + 114]]:
        assert codec.ranks[a, b] == codec.rank.get(codec.inner[a] << 32 | right[b], -1)
    words = [w.encode() for w in ("the", "a", "other", "mother", "bb", "é", "x" * 70, "12345", "unbelievable", "the")]
    assert codec.merge([]) == [] and codec.merge(words) == [codec.merge([w])[0] for w in words]


def test_empty_tables(spark, empty):
    content = __import__("public_tokenizers").path("word_bpe_49k.json")
    assert jaccard.near_documents(empty).count() == 0
    assert passages.drop_repeats(empty).count() == 0
    assert fingerprint.with_next(empty, ["text"]).count() == 0
    assert bpe.encode(empty, bpe.load_vocabulary(content)).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quality.score(empty, quality.fit([], np.array([]))).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept, seen = {}, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        seen = stage(spark, seen, SMALL)
        assert seen.columns == corpus_pipeline.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in seen.collect()}
    low = brute_components(sorted(kept["language ID"].items()), 5, 80)
    assert set(kept["n-gram Jaccard join"]) == {i for i, c in low.items() if i == c}
    assert set(kept["substring dedup"]) == set(kept["n-gram Jaccard join"])
    assert all(len(t) <= len(texts[i]) for i, t in kept["substring dedup"].items())
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and {r["doc_id"] for r in out.collect()} <= set(texts)


def test_passages_of_equal_texts(spark):
    """Texts of the same words: each is a passage of the first one as a whole, and has the passages of that one."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    part = words(60)
    first = " ".join(words(20) + part)
    whole = " ".join(words(30) + part + words(30))
    rows = [(1, first), (5, whole), (9, whole.upper()), (70, whole.replace(" ", "\n")), (200, whole), (201, None), (202, ""), (203, "a b"), (204, "a b")]
    found = {tuple(r) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(i, 30, 90, 1, 20, 80, 60) for i in (5, 9, 70, 200)} | {(i, 0, 120, 5, 0, 120, 120) for i in (9, 70, 200)}


def test_long_common_subsequences():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 70)).astype(np.uint64) for _ in range(2))
        rows = [[0] * (len(b) + 1)]
        for w in a:
            rows.append([0])
            for j, v in enumerate(b):
                rows[-1].append(rows[-2][j] + 1 if v == w else max(rows[-2][j + 1], rows[-1][j]))
        got = passages.subsequence_rows(a, b)
        assert [[j - (row & ((1 << j) - 1)).bit_count() for j in range(len(b) + 1)] for row in got] == rows[1:]
        assert passages.common_words(a, b) == rows[-1][-1]


def test_edited_passages_of_later_holders(spark):
    """Edited passages whose seeds all lie in still earlier documents, in pieces; without them the pair would be found."""
    rows = []
    for g in range(20):
        p, at = prose(70_000 + g, 80), 10 * g
        parts = [p[i:i + 24] for i in range(0, 80, 16)] + [p, edited(p, 0.1, g)]
        rows += [(at + i, " ".join([*prose(80_000 + at + i, 40), *x, *prose(90_000 + at + i, 40)])) for i, x in enumerate(parts)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    last = {r["doc_id"] // 10 for r in found if r["doc_id"] % 10 == 6 and r["source_id"] == r["doc_id"] - 1 and r["n_same"] >= 60}
    assert len(last) >= 18


def test_edited_passages_around_a_stock_line(spark):
    """The only seeds are those of a line that many earlier documents hold; every fifth word behind it is another one."""
    line, rest = prose(61, 30), prose(62, 40)
    rows = [(i, " ".join([*prose(100_000 + i, 30), *line, *prose(110_000 + i, 40)])) for i in range(100)]
    for i in (200, 201):
        other = [f"y{i}-{j}" if j % 5 == 4 and i == 201 else w for j, w in enumerate(rest)]
        rows.append((i, " ".join([*prose(100_000 + i, 30), *line, *other, *prose(110_000 + i, 40)])))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(201, 200)}
    assert found[0]["n_same"] >= 55


def test_documents_around_a_short_stock_line_are_no_pairs(spark):
    """A line of 17 words in many documents is no passage, whatever few words are the same further off: no texts travel for it."""
    line, rest = prose(63, 17), prose(64, 50)
    far = [" ".join(prose(65, 9)[i:i + 3]) for i in (0, 3, 6)]
    rows = []
    for i in range(100):
        x, y = prose(120_000 + i, 60), prose(130_000 + i, 60)
        rows.append((i, " ".join([*x[:24], far[0], *x[24:48], far[1], *x[48:], *line, *y[:40], *far, *y[40:]])))
    for i in (200, 201):
        other = [f"z{i}-{j}" if j % 5 == 4 and i == 201 else w for j, w in enumerate(rest)]
        rows.append((i, " ".join([*prose(120_000 + i, 60), *line, *other, *prose(130_000 + i, 60)])))
    docs = spark.createDataFrame(rows, "id long, text string")
    lists = []
    for i, t in rows:
        seed, at = passages.minimizers(passages.word_hashes(t))
        lists += [(i, s, p) for s, p in zip(seed.view(np.int64).tolist(), at.tolist(), strict=True)]
    posts = spark.createDataFrame(lists, "id long, seed long, at int")
    first = posts.groupBy("seed").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    own = posts.join(first, "seed").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("at", "seed", F.expr("first < id").alias("later")))).alias("s"))
    found = spark.createDataFrame([], passages.PASSAGE)
    got = [(r["a"], r["b"]) for r in passages.later_holders(docs, common.stored(own, "seed-lists"), found).collect()]
    assert (200, 201) in got and len(got) < 1_000  # of 5,151 pairs that hold the line; seeds across its ends are in few documents


def test_runs_of_one_passage():
    """No stretch that an edited passage can have is refused: 40 of 50 words match, in as many runs as words may be lost and added."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(50, 60))
        lost = set(rng.choice(n, n // 5, replace=False).tolist())
        p, x, y = prose(int(rng.integers(1 << 30)), n), prose(int(rng.integers(1 << 30)), 70), prose(int(rng.integers(1 << 30)), 70)
        more = set(rng.choice(n, (n - len(lost)) // 4 - 1, replace=False).tolist())
        edited_p = [v for j, w in enumerate(p) for v in ([] if j in lost else [w]) + ([f"new{j}"] if j in more else [])]
        at = int(rng.choice([j for j in range(n - 1) if not {j, j + 1} & lost]))
        there = sum(j not in lost for j in range(at)) + sum(j in more for j in range(at))
        near = [passages.around(passages.runs(passages.word_hashes(" ".join(t)), 2), i) for t, i in (
            ([*x, *p, *x[::-1]], 70 + at), ([*y, *edited_p, *y[::-1]], 70 + there))]
        rows, bits = passages.near_sets(near)
        assert rows.shape == (2, 2 * passages.AROUND) and bits.shape == (2, passages.BITS // 64)
        assert passages.in_one_passage(near[0], passages.AROUND, rows).all()
    line, plain = prose(66, 17), [prose(67 + k, 60) for k in range(4)]
    near = [passages.around(passages.runs(passages.word_hashes(" ".join([*plain[k], *line, *plain[k + 1]])), 2), 60) for k in (0, 2)]
    assert passages.in_one_passage(near[0], 60, passages.near_sets(near)[0]).tolist() == [True, False]


def test_pairs_in_rounds(spark, monkeypatch):
    """Aligned in rounds, the pairs give the same passages; the table of their texts goes after the last."""
    shared = prose(68, 70)
    docs = spark.createDataFrame([(i, " ".join([*prose(140_000 + i, 40), *shared, *prose(150_000 + i, 20)])) for i in range(12)], "id long, text string")
    pairs = spark.createDataFrame([(a, b) for b in range(12) for a in range(b)], "a long, b long")
    whole = sorted(map(tuple, passages.passages_of(docs, pairs, "whole").collect()))
    sizes, align = [], passages.with_texts
    monkeypatch.setattr(passages, "ROUND", 20)
    monkeypatch.setattr(passages, "with_texts", lambda pairs, texts: (sizes.append(pairs.count()), align(pairs, texts))[1])
    got = passages.passages_of(docs, pairs, "rounds")
    assert sorted(map(tuple, got.collect())) == whole and len(whole) == 66
    assert len(sizes) == 4 and sum(sizes) == 66 and max(sizes) < 40


def test_stored_leaves_no_shuffle_files(spark):
    """A stored frame is read from its files; what was shuffled to write it goes at once. The user's setting stays."""
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, conf = files(), spark.conf.get(common.CLEANUP_CONF)
    frame = spark.range(10_000).withColumn("k", F.col("id") % 1_000).groupBy("k").count()
    kept = common.stored(frame, "counts")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.CLEANUP_CONF) == conf
    assert kept.count() == 1_000 and frame.where("count = 10").count() == 1_000


def left_behind(spark, work) -> set[str]:
    """Labels of the tables below the checkpoint folder that ``work`` leaves."""
    from crawlframe.session import checkpoint_dir
    from crawlframe.sources.snapshots import folders

    before = set(folders(spark, checkpoint_dir(spark)))
    work()
    return {x.rpartition("-")[0] for x in set(folders(spark, checkpoint_dir(spark))) - before if len(x.rpartition("-")[2]) == 32}


def test_operators_remove_their_own_tables(spark, docs):
    """What is left are the tables that the result is read from; the copies of texts, seeds and sets go as soon as nothing reads them."""
    left = left_behind(spark, lambda: passages.repeated_passages(docs).collect())
    assert left == {"equal-texts", "chained-passages", "later-passages", "run-passages"}
    left = left_behind(spark, lambda: jaccard.near_documents(docs, 5, 80).collect())
    assert left == {"shingle-sets", "shingle-classes", "star-links-0", "star-links-1", "block-links", "loose-links"}


def test_only_held_seeds_are_dealt(spark):
    """Seeds that one document alone holds are not shuffled to find out who holds them first."""
    rows = [(i, [7, *range(1_000 * i, 1_000 * i + 500)], list(range(501))) for i in range(1, 21)]
    seeds = spark.createDataFrame(rows, "id long, seeds array<long>, at array<int>")
    got = passages.held_seeds(seeds, spark.createDataFrame([(7, 1)], "seed long, first long")).collect()
    assert {(r["id"], r["at"]) for r in got if r["seed"] == 7} == {(i, 0) for i in range(1, 21)} and len(got) < 100


def test_ends_that_cannot_go_on():
    """The quick bound lets through whatever some first words of both would match in more than two of three."""
    rng, refused = np.random.default_rng(8), 0
    for _ in range(600):
        x, y = (rng.integers(0, rng.integers(2, 40), rng.integers(0, 33)).astype(np.uint64) for _ in range(2))
        best = max((3 * passages.common_words(x[:i], y[:j]) - 2 * max(i, j) for i in range(1, len(x) + 1) for j in range(1, len(y) + 1)), default=0)
        may = passages.may_go_on(x, y)
        assert may or best <= 0
        refused += not may
    assert refused > 100


def test_workers_get_small_batches(spark):
    """A batch of texts is held several times over, so a task never gets 10,000 rows at once."""
    sizes = common.map_rows(spark.range(0, 10_000, 1, 1), lambda rows: {"n": [len(rows["id"])]}, "n long", 100_000).collect()
    assert sum(r["n"] for r in sizes) == 10_000 and max(r["n"] for r in sizes) <= 2_000


def test_pairs_with_texts(spark):
    """The texts of a pair keep their sides, whichever is shorter."""
    texts = spark.createDataFrame([(1, "x" * 9), (2, "y"), (3, "z" * 5)], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    got = {(r["a"], r["b"]): (r["ta"], r["tb"]) for r in passages.with_texts(pairs, texts).collect()}
    assert got == {(1, 2): ("x" * 9, "y"), (1, 3): ("x" * 9, "z" * 5), (2, 3): ("y", "z" * 5)}


def test_blocks_span_large_groups(spark):
    """Of a group of near sets the blocks give a spanning forest, not the pairs: their number grows with the group, not its square."""
    tokens = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = [int(x) for x in jaccard.sketch(np.sort(tokens))]
    rows = spark.createDataFrame([(7, i, 399, i) for i in range(200)], "sig long, id long, n long, c long")
    sketches = spark.createDataFrame([(i, bits, None) for i in range(200)], "id long, sketch array<long>, folded array<long>")
    pairs = jaccard.block_pairs(rows, sketches, "sig", 90, True)
    assert pairs.count() == 199 and components(pairs).where("component = 0").count() == 200
    assert jaccard.block_pairs(rows, sketches, "sig", 90, False).count() == 199 * 100


def test_near_documents_around_the_threshold(spark):
    """Clusters whose pairs are partly links and partly just none: the spanning pairs alone do not decide."""
    rng = random.Random(5)
    rows = []
    for cluster in range(6):
        base = [f"c{cluster}w{i}" for i in range(120)]
        for _ in range(25):
            text = list(base)
            for at in rng.sample(range(120), rng.randint(1, 3)):
                text[at] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text)))
    low = brute_components(rows, 3, 90)
    got = jaccard.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == low and 6 < len(set(low.values())) < len(low)


def test_table_of_frequent_shingles(spark):
    often = spark.createDataFrame([(9, 50), (-1, 40), (3, 40), (4, 33)], "often long, count long")
    tokens, counts = jaccard.most_frequent(often, 3)
    assert tokens.tolist() == [3, 9, (1 << 64) - 1] and counts.tolist() == [40, 50, 40]
    assert jaccard.most_frequent(often, 2)[0].tolist() == [9]
    assert len(jaccard.most_frequent(often.where("count < 0"), 3)[0]) == 0
