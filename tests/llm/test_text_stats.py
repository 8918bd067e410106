"""Prefix trie, collocations and decontamination against brute force, on awkward rows and on small pieces."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlframe.llm import collocations, decontaminate, trie

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- prefix trie ---

def conversations() -> list[tuple]:
    r, rows = random.Random(5), []
    for c in [*range(0, 60), *range(100, 130), *range(205, 230), 1_000_001, 1_000_100, -3]:
        for t in range(r.choice([0, 1, 2, 3, 5, 9]) or (1 if c % 7 else 0)):
            rows.append((c, None if t == 0 and c % 4 == 0 else t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "ccc"])))
    rows += [(40, t, "user", "same") for t in range(400)] + [(c, t, "user", "same") for c in range(300, 330) for t in range(2)]
    rows += [rows[3], rows[5], (None, 1, "user", "nobody"), (7, 50, "user", "tie"), (7, 50, "user", "other tie")]
    return rows


def brute_trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions,nodes,shards", [(4, 50_000, 64), (16, 7, 2), (5, 40, 3)])
def test_prefix_trie(spark, monkeypatch, partitions, nodes, shards):
    """The same nodes in few large and in many small shards, whose spines are merged in several rounds."""
    monkeypatch.setattr(trie, "SHARDS", shards)
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    df = df.withColumns({"conv": F.lit("x"), "key": F.lit(1), "depth": F.lit(None), "labels": F.lit(2)})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = trie.prefix_trie(trie.spliced(df)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, got), key=str) == brute_trie(conversations())


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.spliced(df)).collect() == []


def test_shards_join_to_one_trie():
    """Builders of a few paths each, merged, give what one builder gives."""
    r = random.Random(8)
    paths = sorted({tuple(r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(9))) for _ in range(300)})

    def own(p, i):
        path = [[x, 2, 0, trie.NONE, 0, 0, 0, None] for x in [b"", *p]]
        path[-1][2:4], path[-1][7] = (1 + i % 3, i), str(i)
        return path

    def nodes(out):
        return list(zip(*(out[c] for c in ("lo", "depth", "n", "kids", "leaves", "saved", "ends")), strict=True))

    whole = sorted(nodes(trie.Shard([own(p, i) for i, p in enumerate(paths)], 0, False, True).finished()), key=str)
    done, spines = [], []
    for at in range(0, len(paths), 60):
        made = trie.Builder()
        for low in range(at, min(at + 60, len(paths)), 7):
            done += nodes(made.add([own(p, low + i) for i, p in enumerate(paths[low:min(low + 7, at + 60)])]))
        out = made.rest(at)
        for side in (0, 1):
            spines.append([[out[c][i] for c in ("label", "size", "n", "lo", "kids", "leaves", "saved", "ends")] for i in range(len(out["side"])) if out["side"][i] == side])
    done += nodes(trie.Shard([p for p in spines if p], 0, False, True).finished())
    assert sorted(done, key=str) == whole


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 3_000])
@pytest.mark.parametrize("deep", [0.5, 0.9])
def test_find_close(n, deep):
    r, bits, high, opened, stack, want = random.Random(n), [], 0, 0, [], {}
    while len(bits) < 2 * n:
        if opened < n and (high == 0 or r.random() < deep):
            stack.append(len(bits))
            bits.append(1)
            high, opened = high + 1, opened + 1
        else:
            want[stack.pop()] = len(bits)
            bits.append(0)
            high -= 1
    tree = trie.Parentheses(np.array(bits))
    assert tree.find_close(tree.opens).tolist() == [want[i] for i in tree.opens.tolist()]
    assert tree.pairs(np.array([len(bits)]))[0] == sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))


# --- collocations ---

def phrases(least: int, top: int, rows: list[tuple]) -> list[tuple]:
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in c.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def spoken() -> list[tuple]:
    r = random.Random(11)
    words = ["a", "B", "c", "dé", "É", "f\x00", "g-h", "ñ", "1", "x" * 50]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "?!"]) for _ in range(r.randrange(80)))) for _ in range(150)]
    return [*rows, rows[0], ("en", None), ("en", ""), (None, " \n.."), ("fr", "seul"), ("en", "a B c " * 3_000), ("en", "new york city. " * 40 + "york city, new york! " * 3)]


@pytest.mark.parametrize("at_once", [1, 300, 4_000_000])
@pytest.mark.parametrize("least,top", [(10, 2_000), (3, 7)])
def test_collocations(spark, monkeypatch, at_once, least, top):
    count = collocations.count_stripes
    monkeypatch.setattr(collocations, "count_stripes", lambda docs, buckets: count(docs, buckets, at_once))
    df = spark.createDataFrame(spoken(), "lang string, text string").withColumns({"h": F.lit(1), "bucket": F.lit("z"), "n": F.lit(0), "rank": F.lit(0)})
    got = sorted(map(tuple, collocations.collocations(df, least, top).collect()))
    assert got == phrases(least, top, spoken())


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 9_000_000_000_001, 9_000_000_000_007, 9_500_000_000_003
    row = spark.range(1).select(collocations.cut_score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


# --- decontamination ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_marks(docs: list[tuple], items: list[tuple], size: int) -> list[tuple]:
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        m = min(size, len(w))
        for at in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[at:at + m])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for m in {len(x) for x in wins}:
            for at in range(len(w) - m + 1):
                if tuple(w[at:at + m]) in wins:
                    hit |= set(range(at, at + m))
                    found |= {str(x) for x in wins[tuple(w[at:at + m])] if x is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def bench_rows(short: bool) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(3)
    vocabulary = ["Alpha", "beta", "GAMMA", "é", "Ünd", "7", "x9", "delta", "eps", "zeta"]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(r.randrange(10, 40)))) for i in range(12)]
    items += [(3, items[5][1]), (50, items[5][1]), (None, " ".join(["null", *prose(12)])), (60, None), (61, ""), (62, "?!"), (63, "same " * 30)]
    if short:
        items += [(70 + m, " ".join(f"s{m}w{k}" for k in range(m))) for m in range(1, 10)]
    docs = []
    for i in range(120):
        w = prose(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            t = (r.choice(items)[1] or "").split()
            lo = r.randrange(len(t) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = t[lo:lo + r.randrange(5, 20)]
        docs.append((i, "".join(x + r.choice([" ", ", ", "\n", " - ", "_", "\t\t"]) for x in w)))
    docs += [docs[4], (4, docs[9][1]), (None, items[0][1]), (500, None), (501, ""), (502, " .\n"), (503, "SAME same " * 3_000), (504, items[14][1]), (505, items[1][1].upper().replace("É", "é"))]
    return docs, items


@pytest.mark.parametrize("short,size", [(False, 10), (True, 10), (True, 7), (False, 1)])
def test_contamination(spark, short, size):
    docs, items = bench_rows(short)
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("x"), "m": F.lit(1), "item": F.lit(2), "window": F.lit(3), "gram": F.lit(4)})
    right = spark.createDataFrame(items, "item_id long, text string").withColumns({"w": F.lit(1), "doc_id": F.lit(4)})
    got = [(x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for x in decontaminate.contamination(left, right, size).collect()]
    assert sorted(got, key=str) == brute_marks(docs, items, size)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(x)[1:] for x in decontaminate.contamination(docs, none).collect()] == [(1, 3, 0, [], [])]
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


def test_spans_and_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Start here: {item.upper()}, then (on) it goes."), (2, "clean text, stays."), (3, item), (4, None)], "doc_id long, text string").withColumn("spans", F.lit(7))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert cut == {1: "Start here, then (on) it goes.", 2: "clean text, stays.", 3: "", 4: None}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench, most=0.7).collect()) == [1, 2, 4]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench, most=0.1).collect()) == [2, 4]


def test_native_plan(spark):
    """No Python worker on the main path."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    wins = decontaminate.windows(spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"))
    plan = decontaminate.occurrences(docs, wins)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
