"""Vector operators and chat formatting against brute force."""

import hashlib

import numpy as np
import pytest
from compare import duck, rows
from pyspark.sql import functions as F

from fotoquarry.llm import ann, chat, itq, registry


def unit(v):
    return v / np.linalg.norm(v)


def vector_rows():
    rng = np.random.default_rng(2)
    out = []
    for g in range(6):
        centre = unit(rng.normal(size=32))
        out += [(unit(centre + s * rng.normal(size=32) / 6).tolist(), g % 2) for s in (0, 0.2, 0.5, 0.9, 1.0, 1.1)]
        out += [(centre.tolist(), g % 2)] * 3
    out += [(unit(rng.normal(size=32)).tolist(), 0) for _ in range(30)]
    out += [(None, 0), ([0.0] * 32, 0), ([float("nan")] * 32, 0), ([None] + [1.0] * 31, 0), ([], 0), (out[0][0], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([float("inf")] + [0.0] * 31, 1)]
    return [(k, v, lab) for k, (v, lab) in enumerate(out)] + [(None, out[0][0], 0)]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_vectors_equal_brute_force(spark):
    data = vector_rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "key": F.lit("x"), "links": F.lit(2)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.near_vectors(df).collect()}
    ok = [(i, np.array(v), lab) for i, v, lab in data if i is not None and lab is not None and good(v)]
    near = {i: [j for j, w, m in ok if j != i and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for i, v, lab in ok}
    comp = {i: i for i, *_ in data}
    for _ in data:
        comp.update({i: min([comp[i], *(comp[j] for j in near[i])]) for i in near})
    found = sum(got[i][0] for i in near) / max(1, sum(map(len, near.values())))
    assert found >= 0.97 and all(got[i][0] <= len(near[i]) for i in near)
    assert all(got[i] == (len(near.get(i, [])), comp[i], comp[i] == i) for i, *_ in data if i is not None and (i not in near or got[i][0] == len(near[i])))
    assert got[None] == (0, None, False)


def test_codes_are_balanced_and_keep_angles():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for bits in (64, 156):
        model = {64: itq.learn(x, bits)}
        c = itq.codes(x, model, bits)
        assert c.shape == (2000, bits) and np.abs(c.mean(0) - 0.5).max() < 0.1
        y = x + 0.3 * rng.normal(size=x.shape) / 8
        assert (c != itq.codes(y, model, bits)).sum(1).mean() < 12 * bits / 64


def test_layout_follows_the_rows():
    """Wider segments for more rows: what an unrelated vector meets stays few, and links are met all the same."""
    for rows_ in (10, 1000, 10**5, 10**7, 10**9):
        segments, width, most = itq.layout(rows_, 0.93)
        flip = np.arccos(0.93) / np.pi
        meets = (1 - flip) ** width
        assert (1 - meets) ** segments <= itq.MISSED and most < itq.FIRST / 2
        assert rows_ * segments / 2**width <= 3000


@pytest.mark.parametrize("width", [8, 11, 30])
def test_one_meeting_within_the_first_bits(spark, width):
    """A pair is left in its first common segment if the first bits hold that whole, else in every common segment."""
    segments, whole = 9, itq.FIRST // width
    rng = np.random.default_rng(1)
    signs = rng.integers(0, 2, (300, segments * width)).astype(np.uint8)
    other = signs ^ ((rng.random(signs.shape) < 0.5) & np.repeat(rng.random((300, segments)) < 0.6, width, axis=1)).astype(np.uint8)
    a, b = (itq.segment_values(s, segments, width) for s in (signs, other))
    x = [int(v) for v in itq.segment_values(signs[:, : itq.FIRST] ^ other[:, : itq.FIRST], 1, itq.FIRST)[:, 0]]
    common = [[s for s in range(segments) if p[s] == q[s]] for p, q in zip(a, b)]
    df = spark.createDataFrame([(k, x[k], s) for k, c in enumerate(common) for s in c], "k long, x long, s long")
    got = {}
    for r in df.where(itq._not_met_before(F.col("x"), F.col("s"), width)).collect():
        got.setdefault(r["k"], []).append(r["s"])
    assert sum(map(len, common)) > 600
    for k, c in enumerate(common):
        assert sorted(got.get(k, [])) == ([c[0]] if c and c[0] < whole else c)


def test_labels_and_lengths_that_share_a_hash_do_not_link(spark, monkeypatch):
    """Keys hold only some bits of a label's hash; here they hold none."""
    monkeypatch.setattr(itq.F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    rng = np.random.default_rng(4)
    v = [unit(rng.normal(size=64)).tolist() for _ in range(20)]
    df = spark.createDataFrame([(k, w, str(k % 2), k) for k, w in enumerate(v + v)], "nid long, embedding array<double>, label string, g long")
    assert itq.links(df.where("nid < 20 OR nid % 2 = 0").withColumn("label", F.when(F.col("nid") < 20, "a").otherwise("b")), 0.93).count() == 0
    assert itq.links(df.withColumn("label", F.lit("a")), 0.93).count() == 20


def test_thousands_of_links_are_found(spark):
    """Groups of near vectors among unrelated ones; some pairs just above the threshold, some just below."""
    rng = np.random.default_rng(8)
    data = [unit(rng.normal(size=64)) for _ in range(1200)]
    for _ in range(60):
        centre = unit(rng.normal(size=64))
        data += [unit(centre + rng.uniform(0.05, 0.4) * unit(rng.normal(size=64))) for _ in range(15)]
    x = np.array(data)
    true = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
    got = np.array([r["n_links"] for r in itq.near_vectors(df).orderBy("vec_id").collect()])
    assert true.sum() > 4000 and (got <= true.sum(1)).all() and got.sum() >= 0.999 * true.sum()


def brute_nearest(data, k):
    ok = [(i, np.array(v)) for i, v, _ in data if i is not None and good(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            own = sorted([(-float(v @ w), j) for j, w in ok if j != i and len(w) == len(v)])[:k]
            out[i] = [(j, -s) for s, j in own]
    return out


@pytest.mark.parametrize("k", [5, 20])
def test_nearest_against_brute_force(spark, k):
    data = vector_rows()
    df = spark.createDataFrame(data, "id long, vector array<double>, label int").withColumns({"t": F.lit(1), "bucket": F.lit("x"), "score": F.lit(0)})
    got = {}
    for r in ann.nearest(df, df.where("id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(data, k)
    assert set(got) == {q for q in want if want[q]}
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / len(want[q]) for q in got])
    assert recall >= 0.9
    for q, own in got.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_ties_and_few_candidates(spark, monkeypatch):
    """Equal products in different blocks tie, to the smaller id; one long vector leaves the others almost no bucket, and still all are found."""
    rng = np.random.default_rng(3)
    twin = rng.normal(size=64)
    data = [(k, (twin if k % 3 else rng.normal(size=64)).tolist()) for k in range(300)]
    # Swapped components of equal size give equal products with a query of ones.
    data += [(300 + k, np.roll(np.r_[np.full(8, 0.1 * (1 + k // 8)), np.zeros(56)], k % 8).tolist()) for k in range(40)] + [(400, [1.0] * 64), (401, (1e6 * unit(rng.normal(size=64))).tolist())]
    monkeypatch.setattr(ann, "BLOCK", 50)
    df = spark.createDataFrame(data, "id long, vector array<double>")
    got = {}
    for r in ann.nearest(df, df.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    vectors = {i: np.array(v) for i, v in data}
    for q, own in got.items():
        assert len(own) == 20 and own == sorted(own, key=lambda t: (-t[1], t[0]))
        assert all(s == ann.products(vectors[q][None], vectors[i][None])[0] for i, s in own)
    few = spark.createDataFrame([(k, v) for k, v in data[300:]], "id long, vector array<double>")
    for r in ann.nearest(few, few.where("id % 20 = 0"), 60).groupBy("query_id").count().collect():
        assert r["count"] == 41


def test_empty_tables(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert itq.near_vectors(v).count() == 0
    e = spark.createDataFrame([], "id long, vector array<double>")
    assert ann.nearest(e, e).count() == 0
    m = spark.createDataFrame([], "tree long, node long, parent long, score double, role string, text string")
    assert chat.read_back(chat.format_reply_trees(m)).count() == 0


def test_recall_on_the_table(spark, sf_dir):
    r = ann.op6_nearest(spark, sf_dir).toPandas()
    data = [(x[0], x[1], None) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_nearest(data, 20)
    got = r.groupby("query_id").vec_id.apply(set).to_dict()
    assert np.mean([len(got[q] & {j for j, _ in w}) / len(w) for q, w in want.items()]) >= 0.9
    assert (r.groupby("query_id").size() == 20).all()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir).sql(registry.ORACLES[name]).df())


def test_best_branch_of_a_tree(spark):
    kind = "tree long, node long, parent long, score double, role string, text string"
    m = spark.createDataFrame(
        [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 2.0, "assistant", "good"), (1, 4, 3, None, "user", None), (1, 5, 2, 0.5, None, "x"), (2, 7, 99, 1.0, "user", "orphan"), (3, 1, 2, 0.0, "user", "c"), (3, 2, 1, 0.0, "user", "d"), (None, 1, None, 0.0, "user", "n"), (1, None, None, 5.0, "user", "no node"), (1, 3, 1, 2.0, "assistant", "good")],
        kind,
    )
    got = {r["tree"]: r for r in chat.read_back(chat.format_reply_trees(m)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert got[1]["learned"] == "good" and got[2]["turns"][0]["text"] == "orphan" and got[None]["turns"][0]["text"] == "n" and 3 not in got


def test_long_path(spark):
    n = 300
    m = spark.range(1, n + 1).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.read_back(chat.format_reply_trees(m)).first()
    assert [t["text"] for t in got["turns"]] == [str(k) for k in range(1, n + 1)]


@pytest.mark.parametrize("text", ["", "plain", "<|end|>", "<\\|end|>", "<\\\\|turn|>", "</s>[INST] ok [/INST]", "[\\INST]", "<s><<SYS>>x<</SYS>>", "\\", "<|text|>\n<|turn|>user", "a<|end|", "🎉<|end|>é", "$1\\$2"])
def test_escapes_are_reversible(spark, text):
    kind = "tree long, depth long, role string, text string"
    back = chat.read_back(chat.format_paths(spark.createDataFrame([(1, 1, text, text), (1, 2, "assistant", text), (1, 3, "assistant", "z")], kind))).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(text, text), ("assistant", text), ("assistant", "z")]
    assert back["learned"] == (text * 2 if text == "assistant" else text) + "z"
    body = back["formatted"]
    assert body.count(chat.TURN) == 3 and body.count(chat.END) == 3 and "</s>" not in body


def test_repeated_turns_follow_each_other(spark):
    rows_ = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    back = chat.read_back(chat.format_reply_trees(chat.conversation_messages(rows_))).first()
    said = "".join(f"{t['role']}\n{t['text']}\n" for t in back["turns"])
    assert hashlib.sha256(said.encode()).hexdigest() == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest()
