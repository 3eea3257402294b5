"""Corpus operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fotoquarry.llm import bpe, dedup, html, langid, packing, quality, substrings

WORDS = "the and of to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so".split()


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(0, 9)) for k in rng.integers(0, len(WORDS), n))


def table(spark, rows):
    """Documents with extra columns whose names clash with what the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"fp": F.lit("x"), "root": F.lit(1), "key": F.lit(2), "a": F.lit(3), "d": F.lit(4), "length": F.lit(5), "score": F.lit(6.0), "y": F.lit(7)})


@pytest.fixture(scope="module")
def rows():
    p1, p2, p3 = passage(1, 120), passage(2, 80), passage(3, 60)
    texts = [
        p1, p1, p1 + " tail", passage(4, 30) + " " + p2 + " " + passage(5, 30), p2, "x " + p3 + " y", p3 + "\n" + p3, None, "", "  \t\n", "one", "One two", passage(6, 3000), passage(6, 3000) + " end",
        p2 + " " + p3, "İİ ΑΣ! é漢字 🎉", "a" * 5000, p1.upper(), passage(7, 49), passage(7, 50), "z " + passage(7, 50),
    ]
    out = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return out + [(3, texts[3], "en", "s0", 1), (None, p1, None, None, None), (None, None, None, None, None)]


def words_of(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def brute_simhash(t, width):
    own = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = [" ".join(own[i : i + width]) for i in range(len(own) - width + 1)] if len(own) >= width else [" ".join(own)] if own else []
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, most=4):
    """ids by row of (id, fp): the smallest id reachable."""
    n = len(fps)
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[j] for j in range(n) if (fps[i][1] ^ fps[j][1]).bit_count() <= most]) for i in range(n)]
        if new == comp:
            break
        comp = new
    out = {}
    for k, c in enumerate(comp):
        if fps[k][0] is not None:
            out[c] = min(out.get(c, 1 << 60), fps[k][0])
    return [out.get(c) for c in comp]


@pytest.mark.parametrize("width", [4, 5])
def test_simhash_equals_brute_force(spark, rows, width):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in dedup.near_duplicates(table(spark, rows), width).collect()), key=str)
    fps = [(r[0], brute_simhash(r[1], width)) for r in rows]
    want = sorted(((i, f"{h:016x}", c) for (i, h), c in zip(fps, brute_components(fps))), key=str)
    assert got == want


def test_components_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(12)]
    chain = [int(base[0])]
    for k in range(15):
        chain.append(chain[-1] ^ (0b1111 << (4 * k)))
    fps += chain
    signed = [(k, h - (1 << 64) if h >> 63 else h) for k, h in enumerate(fps)]
    got = {r["fp"]: r["root"] for r in dedup.near_components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    want = brute_components(list(enumerate(fps)))
    groups = {}
    for (_, s), w in zip(signed, want):
        groups.setdefault(w, set()).add(got[s])
    assert all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(set(want))


def test_one_document_of_each_group_stays(spark, rows):
    df = table(spark, rows)
    kept = dedup.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    fps = [(r[0], brute_simhash(r[1], 4)) for r in rows]
    want = {c for (i, _), c in zip(fps, brute_components(fps)) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def brute_removed(rows):
    first = {}
    for i, t, *_ in rows:
        own = words_of(t)
        for k in range(len(own) - 49) if i is not None else []:
            w = tuple(own[k : k + 50])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        own = words_of(t)
        gone = set()
        for k in range(len(own) - 49) if i is not None else []:
            if first[tuple(own[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return out


@pytest.mark.parametrize("how", [{}, {"shard_words": 100, "stream_words": 60}, {"anchor_bits": 2}, {"anchor_bits": 0, "shard_words": 300, "stream_words": 500}])
def test_repeats_equal_brute_force(spark, rows, how):
    """Small shards, many copies of one, and anchors that all collide change nothing."""
    got = sorted((tuple(r) for r in substrings.remove_repeats(table(spark, rows), **how).collect()), key=str)
    want = sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_removed(rows)), key=str)
    assert got == want


def test_cut_texts_keep_columns(spark, rows):
    df = table(spark, rows)
    out = substrings.cut_repeats(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted(((i, t if not g else k) for (i, t, *_), (_, _, g, k) in zip(rows, brute_removed(rows))), key=str)


def test_automaton_statistics():
    m = substrings.Automaton()
    rng = np.random.default_rng(0)
    refs = [[b"abc"[k : k + 1] for k in rng.integers(0, 3, 40)] for _ in range(5)]
    for d, r in enumerate(refs):
        m.add(r, d)
    for span in (2, 4, 6):
        for doc in range(6):
            for q in ([b"abcd"[k : k + 1] for k in rng.integers(0, 4, 60)], refs[doc % 5], refs[0] + refs[3]):
                windows = {tuple(r[i : i + span]) for r in refs[:doc] for i in range(41 - span)}
                want = [k for k in range(len(q) - span + 1) if tuple(q[k : k + span]) in windows]
                assert [s + k for s, n in m.repeats(q, doc, span) for k in range(n)] == want


def test_repeats_of_a_hot_passage(spark):
    """One passage in most documents, in contexts of their own, near copies of one another among them."""
    rng, hot = np.random.default_rng(7), passage(9, 70)
    texts = [f"{passage(100 + k, 30)} {hot} {passage(200 + k, 30)}" for k in range(60)]
    base = passage(10, 150).split()
    for k in range(60):
        own = list(base)
        for at in rng.integers(0, 150, 2):
            own[at] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [(hot + " ") * 5, hot + " " + " ".join(base)]
    data = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    for how in ({}, {"shard_words": 200, "stream_words": 900}):
        got = sorted(tuple(r) for r in substrings.remove_repeats(table(spark, data), **how).collect())
        assert got == sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_removed(data))


def tokenizers_of(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


HARD = ["a  b\n\n c\t\t d   ", "x<|endoftext|> y<|ENDOFTEXT|>", "a  <|endoftext|>  b", "<|startoftext|>a", "  z \x1c\x1d q\x85r", "it's  we'll 'S IT'S", " ", "\n", "é́ ⁠ ab　c  ", " a\r\n  b\r\n", "漢字 かな 🎉🎉!!  ok…!! Ünï&&& é!! 12ab,, ß² Å Å ΑΣ. İx! İ! ǅ, \x01!! a\x01!!", "a" * 3000 + "!" * 500]


def test_words_encode_like_whole_texts():
    path, t = tokenizers_of("byte_bpe_50k.json")
    for text in HARD:
        ids = [i for w in bpe.words(text) for i in (bpe.encode(path, [w])[0])]
        assert ids == t.encode(text, add_special_tokens=False).ids, text
    path, t = tokenizers_of("word_bpe_49k.json")
    for text in HARD:
        assert np.frombuffer(packing.token_bytes([text.encode()], path)[0], "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], text


@pytest.mark.parametrize("most", [200_000, 5])
def test_bpe_round_trip(spark, rows, most, monkeypatch):
    monkeypatch.setattr(bpe.frequent, "__defaults__", (most,))
    path, t = tokenizers_of("byte_bpe_50k.json")
    more = [(100 + k, x, None, None, None) for k, x in enumerate(HARD)]
    got = sorted((tuple(r) for r in bpe.encode_decode(table(spark, rows + more), path).collect()), key=str)
    want = []
    for i, text, *_ in rows + more:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_packing_is_exact_and_tight(spark, rows):
    path, t = tokenizers_of("word_bpe_49k.json")
    got = [r.asDict() for r in packing.pack(table(spark, rows), path).collect()]
    want = []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_plans_hold_the_histogram():
    rng = np.random.default_rng(1)
    for size, n in ((2048, 50_000), (2048, 7), (64, 3000)):
        hist = np.bincount(np.minimum(rng.geometric(3 / size, n), size), minlength=size + 1)
        plan = packing.plan(hist, size)
        held = np.zeros(size + 1, int)
        for content, many in plan:
            assert sum(content) <= size and many > 0
            for v in content:
                held[v] += many
        assert (held == hist).all()
        least = -(-int((np.arange(size + 1) * hist).sum()) // size)
        assert sum(m for _, m in plan) <= least * 1.01 + 2


def test_best_fit_alone():
    hist = np.zeros(11, int)
    hist[[7, 5, 4, 3, 2]] = [3, 4, 1, 5, 2]
    held = np.zeros(11, int)
    for content, many in packing.best_fit(hist.copy(), 10):
        assert sum(content) <= 10
        for v in content:
            held[v] += many
    assert (held == hist).all()


def test_language_is_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "123 !!", None), (None, "the of and", None)], "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    both = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(both).collect()}
    held = [(r["lang"], got[r["doc_id"]]) for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([lang == g["lang_pred"] for lang, g in held]) >= 0.95
    assert all(got[10**6 + k]["lang_pred"] == "und" and got[10**6 + k]["score"] == 0 for k in range(3)) and not got[None]["held_out"]
    assert all(0 <= g["score"] <= 1 and g["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())
    kept = langid.keep_known(both)
    assert kept.columns == both.columns and kept.count() >= 0.99 * docs.count() and kept.where("doc_id >= 1000000").count() == 0
    assert langid.identify(odd.where("lang IS NULL")).where("lang_pred <> 'und'").count() == 0 and langid.identify(docs.limit(0)).count() == 0


def test_kernel_equals_counting():
    texts = ["the cat sat on the mat", "THE dog; sat", "x", "ñandú y más", "\t\n 1 2"]

    def brute(t):
        raw = (" " + re.sub("[^a-z\x80-\uffff]+", " ", t.lower()).strip() + " ").replace("  ", " ").encode()
        return {raw[i : i + n] for n in range(1, 5) for i in range(len(raw) - n + 1)}

    own = [langid.grams(t.encode()) for t in texts]
    sets = [brute(t) for t in texts]
    assert [len(g) for g in own][:4] == [len(x) for x in sets][:4]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets[:4]] for a in sets[:4]]
    assert np.abs(langid.kernel(own[:4], own[:4]) - want).max() < 1e-6


def test_landmarks_against_the_dense_kernel(spark):
    """Predictions against kernel ridge regression on all learned texts, without landmarks and folded weights."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND length(text) > 20").orderBy("doc_id").limit(400).collect()]
    learned, asked = docs[:200], docs[200:]
    model = langid.learn(sorted((r["lang"], langid.grams(r["text"].encode()).tobytes()) for r in learned))
    a, b = ([langid.grams(r["text"].encode()) for r in part] for part in (learned, asked))
    y = np.array([[1.0 if r["lang"] == n else -1.0 for n in model["names"]] for r in learned])
    w = np.array([1 / sum(r["lang"] == q["lang"] for q in learned) for r in learned])
    dense = np.linalg.solve(langid.kernel(a, a) + langid.RIDGE * len(a) * np.diag(w.mean() / w), y)
    want = [model["names"][k] for k in (langid.kernel(b, a) @ dense).argmax(1)]
    got, _ = langid._predict(model, [r["text"].encode() for r in asked], [True] * len(asked))
    assert np.mean([g == w for g, w in zip(got, want)]) >= 0.98


def test_many_languages_are_all_learned(spark):
    """More languages than landmarks of old, in rows of very different number: none is left out."""
    rng = np.random.default_rng(6)
    data, k = [], 0
    for lang in range(90):
        syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
        for _ in range(60 if lang == 0 else 8):
            data.append((k, " ".join("".join(rng.choice(syllables, 2)) for _ in range(25)), f"l{lang:02}"))
            k += 1
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    rows_ = langid.sample(df, most=400)
    assert {lang for lang, _ in rows_} == {x[2] for x in data} and len(rows_) <= 400
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).where("held_out").collect()}
    assert len({data[i][2] for i in got}) > 64 and np.mean([got[i] == data[i][2] for i in got]) >= 0.98


def test_quality_is_found(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, "s", -5)], docs.schema)
    both = docs.unionByName(odd).withColumns({"y": F.lit("clash"), "keep": F.lit(1)})
    got = {r["doc_id"]: r for r in quality.score(both, labels).collect()}
    assert len(got) == docs.count() + 2 and all(0 <= g["score"] <= 1 for g in got.values())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([got[i]["keep"] == (q == 1) for i, q in truth.items()]) >= 0.93
    kept = quality.keep_good(both, labels)
    assert kept.columns == both.columns and {r["doc_id"] for r in kept.collect()} == {i for i, g in got.items() if g["keep"]}
    none = quality.score(both, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and abs(none[0][0] - 0.5) < 1e-9
    assert quality.score(docs.limit(0), labels).count() == 0


def array_pool(text, meta):
    """The unlabelled rows as arrays: the surest by rank, as ``quality.train`` picks them from a table."""

    def surest(model, per_class, taken):
        out = []
        for v, p in enumerate(quality.view_probabilities(model, text, meta)):
            pick = [(c, k) for c, n in per_class.items() for k in [k for k in np.argsort(-p if c else p, kind="stable").tolist() if k not in taken[v]][:n]]
            ks = [k for _, k in pick]
            out.append((text[ks], meta[ks], np.array([float(c) for c, _ in pick]), p[ks], ks))
        return out

    return surest


def test_co_training_exchanges_labels_that_help():
    """Few labels, one strong and one weak view: what the strong one hands over teaches the weak one; a view that knows nothing hands over nothing that weighs."""
    rng = np.random.default_rng(0)
    n = 3000
    y = rng.integers(0, 2, n).astype(float)
    weak = rng.normal(size=(n, 120)) + 0.12 * y[:, None] * np.sign(np.arange(120) % 2 - 0.5)
    strong, noise = rng.normal(size=(n, 3)) + 2.5 * y[:, None], rng.normal(size=(n, 3))
    acc = lambda m, t, x: [((v[60:] >= 0.5) == (y[60:] == 1)).mean() for v in quality.score_batch(m, t, x)]
    args = (weak[:60], strong[:60], y[:60], array_pool(weak[60:], strong[60:]))
    alone, taught = quality.co_train(*args, rounds=0), quality.co_train(*args, rounds=4)
    assert acc(taught, weak, strong)[1] >= acc(alone, weak, strong)[1] + 0.08
    assert acc(taught, weak, strong)[0] >= acc(alone, weak, strong)[0] - 0.02 and acc(taught, weak, strong)[0] >= 0.95
    assert len(taught["exchange"]) == 4 and all(x["metadata"][0] == quality.PER_ROUND and x["metadata"][1] > 100 for x in taught["exchange"])
    idle = quality.co_train(strong[:60], noise[:60], y[:60], array_pool(strong[60:], noise[60:]), rounds=2)
    assert all(x["text"][1] > 100 and x["metadata"][1] < 0.25 * x["metadata"][0] for x in idle["exchange"])
    assert acc(idle, strong, noise)[0] >= 0.97


def test_co_training_on_a_table_equals_arrays(spark):
    """The distributed choice of pseudo-labels against a sort of all rows in memory."""
    rng = np.random.default_rng(2)
    data = []
    for k in range(300):
        good = bool(rng.integers(0, 2))
        own = [WORDS[i] + ("" if good or rng.random() < 0.6 else "&&") for i in rng.integers(0, 40, 30)]
        data.append((k, " ".join(own), "en", f"site{rng.integers(0, 4) + 4 * (good if rng.random() < 0.9 else not good)}", len(" ".join(own)), int(good)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, quality int").repartition(5)
    model = quality.train(df, df.where("doc_id < 90").select("doc_id", "quality"), rounds=2, per_round=20)
    order = sorted(range(90), key=lambda i: (zlib.crc32(str(i).encode()), str(i)))
    feature = lambda f, ids: np.array([f(data[i]) for i in ids])
    text, meta = (lambda r: quality.text_features(r[1].encode())), (lambda r: quality.meta_features(r[2], r[3], r[4]))
    rest = sorted(range(90, 300), key=lambda i: (zlib.crc32(str(i).encode()), i))
    want = quality.co_train(feature(text, order), feature(meta, order), np.array([float(data[i][5]) for i in order]), array_pool(feature(text, rest), feature(meta, rest)), rounds=2, per_round=20)
    assert [sorted(x) for x in model["exchange"]] == [["metadata", "text"]] * 2
    t, m = feature(text, range(300)), feature(meta, range(300))
    assert np.abs(quality.score_batch(model, t, m)[0] - quality.score_batch(want, t, m)[0]).max() < 0.05
    for a, b in zip(model["exchange"], want["exchange"]):
        assert all(a[v][0] == b[v][0] == 20 and abs(a[v][1] - b[v][1]) < 0.5 for v in a)


PAGES = {
    "<nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three<p><b>Four</article><footer>&copy; x</footer>": "A & B\nOne two three\nFour",
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- <p>no</p> --><div class=\"ad\">Buy now all of it here</div><article><p>Text &lt;b&gt; &eacute;&nbsp;x</p><aside>Side words here and more of them</aside><div class='comments'><p>First!</p></div></article></body>": "Text <b> é x",
    "<header><p>Site name</p></header><main><article><header><h1>Title</h1></header><p>Body <a href=x>link</a>, end.</p><form><input><label>Mail</label></form></article></main><div id='cookie-notice'>We use cookies on this site for everything you do</div>": "Title\nBody link, end.",
    "": "", None: "", "<nav>a</nav>": "",
    "<article><p>a < b and c > d</p><p title=\"x > y\">q</p></article>": "a < b and c > d\nq",
}


def test_main_text_of_pages(spark):
    for page, want in PAGES.items():
        assert html.main_text(page) == want, page
    df = spark.createDataFrame([(k, None if k % 2 else "u", h) for k, h in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).orderBy("page_id").collect()] == [(k, t, len(t)) for k, t in enumerate(PAGES.values())]


def test_decision_tree_learns_its_table_from_neighbours():
    x, y = html.LABELLED[:, :-1], html.LABELLED[:, -1]
    assert np.mean([(html.judge(html.trained(), r) >= 0.5) == (v == 1) for r, v in zip(x, y)]) >= 0.95

    def columns(tree):
        return {html.COLUMNS[tree[0]], *columns(tree[2]), *columns(tree[3])} if isinstance(tree, tuple) else set()

    assert {"words", "links", "words_before", "words_after", "links_after"} <= columns(html.trained())
    # Words and links outvote a name both ways.
    prose = "<p>" + "word " * 50 + "</p>"
    assert html.main_text(f"<div class='related-box'>{prose * 3}</div>").count("word") == 150
    assert html.main_text("<div id='content'><ul>" + "<li><a href='x'>One link</a></li>" * 6 + "</ul></div>") == ""
    assert html.main_text(f"<nav>{prose * 3}</nav><div class='comments'>{prose * 3}</div><aside>{prose * 2}</aside>") == ""
    for page in ("<main><div class='social-history'><p>Short.</p></div></main>", "<form><div class='layout with-sidebar'><article>Short.</article></div></form>", "<div class='overflow-hidden rounded'><article>Short.</article></div>", "<div class='related-content article'><p>Short.</p></div>"):
        assert html.main_text(page) == "Short.", page


def test_hints_that_leave_nothing():
    """Prose in one part that is called none of the article is the article; prose in several parts is what each is called."""
    prose, other = "<p>" + "word " * 50 + "</p>", "<p>" + "other " * 50 + "</p>"
    text = ("word " * 50).strip()
    assert html.main_text(f"<div class='comments'><div>{prose}</div><div class='reply'>{prose}</div></div><footer>&copy; x</footer>") == f"{text}\n{text}"
    assert html.main_text(f"<div class='comments'>{prose}</div><div class='comments'>{other}</div>") == ""
    assert html.main_text(f"<nav>{prose}</nav><div class='sponsored'>{other}</div>") == ""
    assert [b[5] for b in html.blocks("<nav>a<p>b</p></nav>c<aside>d<main>e</main>f</aside>")] == [1, 1, 0, 2, 0, 2]


def random_page(rng):
    """A page of known main text, and that text block by block."""
    words = lambda lo, hi: " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), rng.integers(lo, hi)))
    links = lambda n: "".join(f"<li><a href='/{k}'>{words(1, 3)}</a></li>" for k in range(n))
    main = [words(15, 90) for _ in range(rng.integers(2, 8))]
    title = words(3, 9)
    body = "".join(f"<p>{t}</p>" for t in main)
    head = f"<html><head><title>{title}</title><script>if (a < b) x('<p>');</script></head><body><nav><ul>{links(6)}</ul></nav><div class='ad-slot'>{words(5, 12)}</div>"
    foot = f"<div class='comment-list'><p>{words(10, 50)}</p><p>{words(10, 50)}</p></div><div class='sidebar'><ul>{links(5)}</ul></div><footer>&copy; {words(3, 8)}</footer></body></html>"
    kind = rng.integers(0, 4)
    if kind == 0:
        return f"{head}<article><h1>{title}</h1>{body}<ul>{links(3)}</ul></article>{foot}", None, main
    if kind == 1:
        return f"{head}<div id='main-content'><h1>{title}</h1>{body}</div>{foot}", [title, *main], main
    if kind == 2:
        return f"{head}<div><h1>{title}</h1>{body}</div><div><ul>{links(7)}</ul></div>{foot}", [title, *main], main
    return f"{head}<table><tr><td><ul>{links(5)}</ul><td>{body}</table>{foot}", main, main


def test_extraction_of_generated_pages():
    """Against the text that the pages were made from: all of the article, and next to nothing else."""
    rng = np.random.default_rng(4)
    kept = said = right = 0
    for _ in range(200):
        page, want, main = random_page(rng)
        got = html.main_text(page).split("\n")
        assert want is None or sum(g in want for g in got) >= len(want) - 1
        kept, right, said = kept + sum(len(g.split()) for g in got), right + sum(len(g.split()) for g in got if g in main), said + sum(len(m.split()) for m in main)
    assert right / said >= 0.98 and right / kept >= 0.9


def test_decoded_text_comes_from_the_ids(spark, monkeypatch):
    """With other pieces for the same ids the decoded text is another one: words of the table and words beyond it."""
    import hashlib

    path, _ = tokenizers_of("byte_bpe_50k.json")
    pieces = bpe.pieces(path)
    monkeypatch.setattr(bpe, "pieces", lambda p: [(i, b"<%d>" % i) for i, _ in pieces])
    monkeypatch.setattr(bpe.frequent, "__defaults__", (2,))
    texts = ["one two one two one", "rare words here"]
    got = {r["doc_id"]: r["decoded_sha256"] for r in bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for k, text in enumerate(texts):
        ids = bpe.encode(path, [text])[0]
        assert got[k] == hashlib.sha256("".join(f"<{i}>" for i in ids).encode()).hexdigest()


def test_extraction_without_names():
    """The same pages with every name taken away: only words and links of blocks and their neighbours are left to decide by."""
    import re

    rng = np.random.default_rng(11)
    kept = said = right = 0
    for _ in range(200):
        page, _, main = random_page(rng)
        page = re.sub(r"(?i)<(/?)(article|main|nav|footer|header|aside|form|section)\b", r"<\1div", page)
        page = re.sub(r"""(?i)\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", "", page)
        assert not re.search(r"(?i)<(article|main|nav)|class=|role=", page)
        got = html.main_text(page).split("\n")
        kept, right, said = kept + sum(len(g.split()) for g in got), right + sum(len(g.split()) for g in got if g in main), said + sum(len(m.split()) for m in main)
    print(f"recall {right / said:.3f}, precision {right / kept:.3f}")
    assert right / said >= 0.9 and right / kept >= 0.75


def test_names_that_mislead_and_names_that_do_not():
    prose = "It rained on the hills all night, and in the morning the river stood so high that nobody could cross it until noon came. " * 2
    p, text = f"<p>{prose}</p>", prose.strip()
    pages = {
        f'<nav><a href=x>Home</a></nav><article><section id="cookies">{p}{p}</section></article>': 2, f'<article><section id="menu">{p}</section></article>': 1, f'<article>{p}<div id="reply">{p}</div></article>': 2,
        f'<article><div class="author-comments">{p}{p}</div></article>': 2, f'<body><div class="comment">{p}{p}</div></body>': 2, f'<article>{p}<section class="comments"><p>{prose} no</p></section></article>': 1, f'<article>{p}<section id="comments"><p>{prose} no</p></section></article>': 1,
        f"<article>{p}<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul>{p}</article>": 2, f'<article>{p}<div class="promo">Buy this, it is a promo of some words for all of your friends out there.</div>{p}</article>': 2,
        f'<article>{p}<div class="notice">Something of note.</div>{p}<div class="alert alert-warning">Beware. {prose}</div></article>': 2, f'<article>{p}<div class="share">Share this</div>{p}</article>': 2,
        '<nav><a href=x>Home</a><a href=y>More</a></nav><footer><a href=z>Imprint</a></footer>': 0,
    }
    for page, n in pages.items():
        assert html.main_text(page) == "\n".join([text] * n), page


def test_text_blocks_equal_a_plain_walker():
    """The blocks of well-formed pages against a second implementation on the standard parser."""
    import html.parser

    class Walker(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.skip = [], "", 0

        def cut(self):
            if self.now.split():
                self.out.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "title")
            if tag not in ("a", "b"):
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "title")
            if tag not in ("a", "b"):
                self.cut()

        def handle_data(self, data):
            if not self.skip:
                self.now += data

    from fotoquarry.llm.html import blocks

    rng = np.random.default_rng(5)
    for _ in range(100):
        page = random_page(rng)[0]
        w = Walker()
        w.feed(page)
        w.cut()
        assert [b[0] for b in blocks(page)] == w.out


@pytest.mark.parametrize("part", ["<a href=", '<a "', "<div><p>x", "<!--", "<script>", "<![CDATA[", "<a '\">", "<", "<ul><li>", "</p>", "<a \"<b>' "])
def test_broken_pages_take_linear_time(part):
    import time

    start = time.monotonic()
    html.main_text(part * (1_000_000 // len(part)))
    assert time.monotonic() - start < 6


def test_empty_tables(spark, rows):
    none = table(spark, rows).limit(0)
    path, _ = tokenizers_of("word_bpe_49k.json")
    assert dedup.near_duplicates(none).count() == 0 and substrings.remove_repeats(none).count() == 0 and packing.pack(none, path).count() == 0
    assert bpe.encode_decode(none, tokenizers_of("byte_bpe_50k.json")[0]).count() == 0


@pytest.mark.parametrize("langs", [("de",), ("de", "en"), ("de", "en", "es", "fr")])
def test_unlearned_languages_and_junk_go(spark, langs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = docs.where(F.col("lang").isin(*langs))
    rng = np.random.default_rng(3)
    junk = ["".join(rng.choice(list("qwrtzpsdfghjklxcvbnmaeiou     "), n)) for n in (40, 200, 600)] + ["xqz " * 50, "Zażółć gęślą jaźń i wszystkie inne polskie słowa które są tutaj"]
    junk += ["Это русский текст о погоде и природе, который никто не учил", "这是一个中文文本没有人学习过", "Tämä on suomenkielinen teksti jota kukaan ei ole opettanut mallille"]
    odd = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = langid.keep_known(own.unionByName(odd.select(own.columns)))
    ids = {r["doc_id"] for r in kept.collect()}
    assert not [junk[i - 10**6] for i in ids if i >= 10**6]
    assert sum(r["doc_id"] in ids for r in own.collect()) >= 0.998 * own.count()
    other = docs.where(~F.col("lang").isin(*langs)).withColumn("lang", F.lit(None).cast("string"))
    stays = langid.keep_known(own.unionByName(other)).join(other.select("doc_id"), "doc_id", "left_semi").count()
    assert len(langs) == 1 or stays <= 0.03 * other.count()


def brute_jaccard(texts, width=5):
    """Rows by row: the smallest row reachable over shingle sets of similarity 0.8 or more."""
    sets = []
    for t in texts:
        own = words_of((t or "").lower())
        sets.append({tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set())
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    comp = list(range(len(sets)))
    for _ in sets:
        new = [min(comp[j] for j in range(len(sets)) if alike(sets[i], sets[j])) for i in range(len(sets))]
        if new == comp:
            break
        comp = new
    return comp


def test_near_dedup_stage_keeps_one_of_pairs_over_four_fifths(spark, monkeypatch):
    import corpus_pipeline

    texts = []
    for seed in range(60):
        own = passage(1000 + seed, 400).split()
        texts.append(" ".join(own))
        # k words far apart change 5 k of 396 shingles: similarities of 0.97 down to 0.68.
        for at in range(k := 1 + seed % 15):
            own[10 + at * (380 // k)] = f"new{at}"
        texts.append(" ".join(own))
    texts += [None, "", "one", "One", texts[0] + " " + texts[0]]
    df = table(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, texts[2], "en", "s", 0)])
    want = brute_jaccard(texts)
    kept = sorted({*want})
    assert len(kept) < 95 and sum(a != b for a, b in zip(want[1:120:2], range(1, 120, 2))) > 30
    for block in (dedup.BLOCK, 1):
        monkeypatch.setattr(dedup, "BLOCK", block)
        got = corpus_pipeline.near_dedup(spark, df, "")
        assert got.columns == df.columns
        assert sorted(r["doc_id"] for r in got.where("doc_id IS NOT NULL").collect()) == kept and got.where("doc_id IS NULL").count() == 1
    old = [r["doc_id"] for r in dedup.keep_first(df, width=5).collect()]
    assert len(old) > len(kept) + 1
