"""Personal data, periodic runs and hard negatives against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from compare import duck, rows
from pyspark.sql import functions as F

from fotoquarry.llm import negatives, periodic, private

# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def accepted(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in found.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def naive(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if accepted(k, m.group())]


@pytest.fixture(scope="module")
def field():
    return private.train()


def test_base_equals_plain_patterns(field):
    rng, tagger = random.Random(3), private.Tagger(field)
    for alphabet in ("a@.1 +(-)9_é\n4", "1.2 3-", "+1()- 5", "a@b.-@"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(4000)]
        for text, got in zip(texts, private.all_spans(tagger, [t.encode() for t in texts])):
            assert [s[:3] for s in got if s[3]] == naive(text)


def test_pieces_decode_as_the_whole_chain(field):
    rng, tagger = random.Random(5), private.Tagger(field)
    assert field["reach"] > 0
    words = ["und", "the", "of,", "4111111111111111", "+1", "(212)", "555-0199", "10.0.0.1", "x@y.example", "1998", "(4", "a[at]b.example"]
    texts = [" ".join(rng.choices(words, [9, 9, 9] + [1] * 9, k=rng.randrange(60))).encode() for _ in range(1500)]
    assert private.added_spans(tagger, texts) == private.added_spans(tagger, texts, 0)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4):
        e, t = rng.normal(size=(5, n, 3)), rng.normal(size=(3, 3))
        for own, got in zip(e, private.viterbi(e, t)):
            value = lambda p: sum(own[i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise((0, *p, 0)))
            assert tuple(got) == max(itertools.product(range(3), repeat=n), key=value)


def test_field_learns_its_table_and_reads_on(field):
    tagger = private.Tagger(field)
    for row in private.labelled():
        (got,) = tagger.decode([np.array([tagger.word_class(w) for w, _ in row])])
        assert [private.LABELS[k] for k in got] == [label for _, label in row]
    # Neighbours that hide each other from the patterns, and forms that none of them names.
    cases = {
        "ya no +1 (555) 555-9876 4539578763621486 de la": [("card", "4539578763621486"), ("phone", "+1 (555) 555-9876")],
        "so 4556737586899855 93.184.216.34 ging es": [("card", "4556737586899855")],
        "um 151.101.1.69 6011111111111117 und": [("card", "6011111111111117")],
        "ring (415) 555-2671 at once": [("phone", "(415) 555-2671")],
        "an max.mustermann[at]firma.example.net schreiben": [("email", "max.mustermann[at]firma.example.net")],
        "in 2004 licence version 3.0. of 17 pages (12) cost 1,250.00 on 2024-01-31": [],
        'und token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" oder password=88395838205801c04': [],
    }
    for text, want in cases.items():
        (got,) = private.all_spans(tagger, [text.encode()])
        assert [(k, text[s:e]) for k, s, e, base in got if not base] == want, text


def test_spans_of_texts_of_all_kinds(spark):
    long = "é wort " * 60_000 + "info@x.example.org " + "1 " * 5000
    data = [(1, None), (2, ""), (3, "ñ +1 (555) 555-9876 4539578763621486"), (3, "ñ +1 (555) 555-9876 4539578763621486"), (None, "a@b.example"), (4, long), (5, "x\x00 10.0.0.1")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"spans": F.lit(1), "kind": F.lit("x")})
    got = sorted(((r["doc_id"] or -1), [tuple(s) for s in r["spans"]]) for r in private.private_spans(df).collect())
    assert [i for i, _ in got] == [-1, 1, 2, 3, 3, 4, 5]
    at = long.index("info")
    assert dict(got) == {-1: [("email", 0, 11, True)], 1: [], 2: [], 3: [("card", 20, 36, False), ("phone", 2, 19, False)], 4: [("email", at, at + 18, True)], 5: [("ip", 3, 11, True)]}
    assert private.private_spans(df.limit(0)).count() == 0


def test_private_query_on_given_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in private.op11_private_data(spark, sf_dir).collect()}
    docs = duck(sf_dir).sql("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        want, row = naive(text or ""), got[doc_id]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        spans = [s.split(":") for s in row["spans"].split(",") if s]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= {":".join(s) for s in spans}
        assert [(list(BASE).index(k), int(s)) for k, s, _ in spans] == sorted((list(BASE).index(k), int(s)) for k, s, _ in spans)


# --- periodic runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if not any(all(s[t] == s[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(2500):
        n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


def test_runs_of_long_texts_and_collapse():
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs(np.array(list(range(1000)) * 200)) == [(0, 200_000, 1000)]
    # A long block in which every short gram occurs twice.
    block = [*range(9), 50, *range(9), 51]
    assert periodic.runs(np.array(block * 5)) == [(0, 100, 20)]
    words = "x a b a b a b a b y".split()
    assert periodic.collapsed(words, periodic.runs(periodic.numbered(words))) == "x a b y".split()


def test_periodic_runs_of_texts_of_all_kinds(spark):
    data = [(1, None), (2, ""), (3, "a\x0ba\ta a\n a a\x0c"), (3, "a\x0ba\ta a\n a a\x0c"), (None, "b " * 7), (4, "é\xa0é " * 6), (5, " \n")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"runs": F.lit(1), "kept": F.lit("x"), "n_words": F.lit(0)})
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic.periodic_runs(df).collect()}
    assert got == {1: (0, [], ""), 2: (0, [], ""), 3: (6, [(0, 6, 1)], "a"), None: (7, [(0, 7, 1)], "b"), 4: (6, [(0, 6, 1)], "é\xa0é"), 5: (0, [], "")}
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_planted_runs(spark):
    data = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (7, None), (8, "\t\n")]
    got = periodic.with_planted_runs(spark.createDataFrame(data, "doc_id long, text string")).collect()
    for (i, text), row in zip(data, got):
        w = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not w:
            assert row["text"] == text
            continue
        a, n = (h // 10) % len(w), len(w)
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        assert row["text"].split() == [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


@pytest.mark.parametrize("query,sql", [(periodic.op12_periodic_runs, periodic.ORACLES["op12_periodic_runs"]), (negatives.op13_hard_negatives, negatives.ORACLES["op13_hard_negatives"])])
def test_queries_equal_sql(spark, sf_dir, query, sql):
    assert rows(query(spark, sf_dir).toPandas()) == rows(duck(sf_dir).sql(sql).df())


# --- hard negatives


@pytest.mark.parametrize("axes,bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    place = negatives.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, q = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (7, 6))
        least, most = negatives.bounds(q.astype(float), x.min(0)[None].astype(float), x.max(0)[None].astype(float))
        assert ((q @ x.T >= least) & (q @ x.T <= most)).all()


def plain_negatives(data, is_anchor, positives=5, negatives=5):
    ok = sorted({(i, lab, tuple(q)) for i, lab, q in data if i is not None and lab is not None and q}, key=repr)
    out, asked = [], set()
    for i, lab, q in sorted(ok):
        if not is_anchor(i) or i in asked:
            continue
        asked.add(i)
        scored = [(-sum(a * b for a, b in zip(q, r)), j, m) for j, m, r in ok if j != i and len(r) == len(q)]
        for p, j, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            fit = sorted(s for s in scored if s[2] != lab and -80 * p <= -100 * s[0] <= -100 * p)[:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread,block", [(2, 8), (40, 16), (100, 64)])
def test_negatives_equal_brute_force(spark, spread, block):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-100, 100, (12, 6))
    data = [(k, int(k % 3), (centres[k % 12] + rng.integers(-spread, spread + 1, 6)).tolist()) for k in range(700)]
    data += [(1000 + k, 1, data[3][2]) for k in range(150)] + [(2000 + k, 2, data[3][2]) for k in range(150)]  # hot vector, ties
    data += [(5, 1, [9, 9]), (3000, 0, [7, 7]), (3001, 0, [6, 7]), (3002, None, [1] * 6), (None, 1, [1] * 6), (3003, 1, None), (3004, 1, []), (10, 1, data[10][2]), data[20], data[20]]
    df = spark.createDataFrame(data, "id long, label int, q array<bigint>").withColumns({"unit": F.lit(1), "block": F.lit(2), "windows": F.lit(3)})
    got = negatives.hard_negatives(df, df.where("id % 10 = 0"), block=block)
    assert sorted(map(tuple, got.collect())) == plain_negatives(data, lambda i: i % 10 == 0)


def test_blocks_are_skipped_where_vectors_lie_in_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 100
    data = [(k, int(k % 40) % 10, (centres[k % 40] + rng.normal(size=16) * 5).astype(int).tolist()) for k in range(8000)]
    df = spark.createDataFrame(data, "id long, label int, q array<bigint>")
    index = negatives.Index(df, 16)
    asked = df.where("id % 100 = 0").withColumn("windows", F.expr("array(struct(double('-Infinity') AS low, double('Infinity') AS high))"))
    near = index.search(asked, True, 5)
    tight = asked.join(near.where("rank = 5").select("anchor", "score"), F.col("id") == F.col("anchor")).withColumn("windows", F.expr("array(struct(double(score) AS low, double('Infinity') AS high))"))
    index.parts = 1
    read = index.chosen(tight.select("id", "label", "q", "windows", F.lit(0).alias("part")), True, False).agg(F.sum(F.size("blocks"))).first()[0]
    assert read < 0.25 * asked.count() * index.zones.count()


def test_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, label int, q array<bigint>")
    some = spark.createDataFrame([(100, 1, [1, 2])], "id long, label int, q array<bigint>")
    assert negatives.hard_negatives(none, none).count() == negatives.hard_negatives(some, some).count() == negatives.hard_negatives(some, none).count() == 0


def test_which_vectors_take_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 0, [0.5, -0.001]), (2, 0, [nan, 1.0]), (3, 0, [inf, 1.0]), (4, 0, [None, 1.0]), (5, None, [1.0, 1.0]), (None, 0, [1.0, 1.0]), (6, 0, []), (7, 0, None), (8, 1, [0.0, 0.0])]
    got = negatives.quantised(spark.createDataFrame(data, "id long, label int, vector array<float>")).collect()
    assert [tuple(r) for r in got] == [(1, 0, [128, -1]), (8, 1, [0, 0])]
