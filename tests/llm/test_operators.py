"""The text operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterwise.llm import backoff_lm, decision_list, knn_quality, language_id, ngram_join, pivotal_mix, preferences, queries, suffix_arrays, warc
from meterwise.llm import words as W
from meterwise.plans.compare import compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def odd_docs(n=80, seed=3):
    """Documents with nulls, empty, very long and repeated texts, ties and repeated rows."""
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "é", "ñandú", "delta,", "x1", "***"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), len(text)))
        if i % 5 == 0 and text:
            rows.append((1000 + i, text + " zulu", "en", "s3", len(text)))
    long = " ".join(rng.choice(vocab) + str(rng.randint(0, 999)) for _ in range(20000))
    return [*rows, rows[0], (None, "alpha beta", None, None, None), (5000, None, "en", "s1", None), (5001, "", "en", "s1", 0), (5002, " \n\t", "en", None, 3), (5003, long, "en", "s2", 1), (5004, long, "en", "s2", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, con, name):
    r = compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con, queries.ORACLES[name])
    assert r["match"], r


def test_word_hashes_agree_across_blocks():
    texts = ["a bb  a", "", "bb " * 200000 + "a", "\n"]
    buf, offs = W.text_bytes(pa.array(texts))
    starts, ends, first = W.split_words(buf, offs, W.NON_SPACE)
    h = W.word_hashes(buf, starts, ends)
    assert list(np.diff(first)) == [3, 0, 200001, 0]
    assert h[0] == h[2] == h[-1] and len(set(h.tolist())) == 2


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_contamination_by_brute_force(spark, docs, block_bytes):
    rng = random.Random(1)
    long = [r[1] for r in odd_docs() if r[1] and len(words(r[1])) > 20]
    items = [(k, " ".join(words(t)[:17]).upper()) for k, t in enumerate(rng.sample(long, 6))] + [(50, "alpha beta"), (51, None), (52, "?"), (None, "gamma gamma"), (50, "alpha beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = defaultdict(set)
    for i, t in items:
        w = words((t or "").translate(AZ), pat)
        for a in range(max(1, len(w) - 12)) if w else []:
            wins[tuple(w[a : a + 13])].add(i)
    want = []
    for i, t, *_ in odd_docs():
        w, hit, found = words((t or "").translate(AZ), pat), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[tuple(w[a : a + n])] - {None}
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = suffix_arrays.scan(docs, bench, block_bytes=block_bytes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = suffix_arrays.decontaminate(docs.withColumn("n_hit", F.lit(7)), bench, block_bytes=block_bytes)
    assert kept.count() == sum(not x[5] for x in want) and kept.columns[-1] == "n_hit"
    assert suffix_arrays.scan(docs.limit(0), bench).count() == 0
    assert not suffix_arrays.scan(docs, bench.limit(0)).where("n_hit > 0").count()


def test_groups_by_brute_force(docs):
    rows = odd_docs()
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(AZ))
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    want = sorted(str((rows[k][0], len(sets[k]), least[root[k]] if sets[k] else rows[k][0])) for k in range(len(rows)))
    got = ngram_join.groups(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    kept = ngram_join.keep_one(docs.withColumn("root", F.lit(1)))
    assert kept.columns == [*docs.columns, "root"]
    alone = sum(not s for s in sets)
    assert kept.count() == alone + len({root[k] for k in range(len(rows)) if sets[k]})
    assert ngram_join.groups(docs.limit(0)).count() == 0


def test_unlinked_documents_stay_whatever_their_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, text(k)) for k in range(5)] + [(7, text(k)) for k in range(5, 8)] + [(8, text(9)), (None, text(9)), (9, text(9) + " more")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted(text(k) for k in [*range(8), 9])


def test_link_block_prunes_nothing_that_links():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(8)]
    sets = [np.unique(np.concatenate([base[k % 8][: rng.integers(150, 200)], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)])) for k in range(120)]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert ngram_join.link_block(sets, 75).tolist() == root


def near_copies(rng, n, words=26):
    """Sets of about 22 shingles: copies of copies, most at one edit at the end."""
    texts = [[f"b{c}w{k}" for k in range(words)] for c in range(3)]
    for _ in range(n - len(texts)):
        t = list(texts[rng.integers(0, len(texts))])
        t[rng.choice([0, 1, words - 1, words - 2, words // 2], p=[0.3, 0.1, 0.4, 0.1, 0.1])] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(t)
    buf, offs = W.text_bytes(pa.array([" ".join(t) for t in texts]))
    sets, at = ngram_join.shingle_sets(buf, offs)
    return [sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def test_link_block_of_near_copies_equals_brute_force():
    sets = near_copies(np.random.default_rng(9), 500)
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if root[a] != root[b]:
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root[a], root[b]))
                    root = [x if r == y else r for r in root]
    assert 3 <= len(set(root)) < 400
    assert ngram_join.link_block(sets, 75).tolist() == root


def test_a_large_block_of_near_copies_takes_linear_time():
    import time

    base = [np.unique(np.random.default_rng(c).integers(0, 1 << 63, 22).astype(np.uint64)) for c in range(2)]
    rng = np.random.default_rng(1)
    sets = []
    for k in range(100_000):  # copies with one shingle replaced: any two of a base have 20 of 24 in common
        s = base[k % 2].copy()
        s[rng.integers(0, 22)] = rng.integers(0, 1 << 63)
        sets.append(np.sort(s))
    t = time.time()
    root = ngram_join.link_block(sets, 75)
    assert time.time() - t < 120  # 100,000 sets; a pass over all pairs would take hours
    assert set(root.tolist()) == {0, 1} and (root[::2] == 0).all() and (root[1::2] == 1).all()


def test_mix_takes_the_same_texts_in_any_order(spark, monkeypatch):
    """Rows that share id and size: the draw goes by the text, not by the order of arrival."""
    monkeypatch.setattr(pivotal_mix, "BUCKET", 8)
    rows = [(None if k % 2 else 7, f"alpha beta w{k}", None, f"s{k % 3}", 1) for k in range(120)]
    got = [Counter(r.text for r in pivotal_mix.mix(spark.createDataFrame(x, DOC).repartition(n)).collect()) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert got[0] == got[1] and 0 < len(got[0]) < 120


def test_mix_meets_targets(spark, docs, monkeypatch):
    monkeypatch.setattr(pivotal_mix, "BUCKET", 8)
    monkeypatch.setattr(pivotal_mix, "FAN", 3)
    plain = docs.where("doc_id < 5000")
    got = pivotal_mix.taken(plain).collect()
    rows = [r for r in odd_docs() if r[0] is not None and r[0] < 5000]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, open_, want = sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not stop:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in stop:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= stop
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken == r.copies * r.size <= 3 * r.size
        total[source[r.doc_id]] += r.taken
    assert len(got) == len(rows)
    assert all(abs(total[s] - want[s]) <= 60 for s in order)  # one document has 60 words at most
    again = pivotal_mix.taken(plain).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = pivotal_mix.mix(plain.withColumn("rank", F.lit("x")))
    assert mixed.count() == sum(r.copies for r in got) and mixed.columns == [*docs.columns, "rank"]
    assert pivotal_mix.taken(docs.limit(0)).count() == 0


def test_pivot_keeps_mass_and_expectation():
    for one, two in (((5.0, 0.3), (2.0, 0.6)), ((1.0, 0.5), (1.0, 0.5)), ((3.0, 0.9), (7.0, 0.9)), ((100.0, 0.2), (1.0, 0.7))):
        (a, p), (b, q) = one, two
        mean = np.zeros(2)
        for draw in (np.arange(4000) + 0.5) / 4000:
            x, y = pivotal_mix.pivot(one, two, draw)
            assert a * x + b * y == pytest.approx(a * p + b * q) and (x in (0.0, 1.0) or y in (0.0, 1.0))
            mean += (x, y)
        assert mean / 4000 == pytest.approx((p, q), abs=2e-3)


def test_warc_round_trip(spark):
    big = "<p>" + "ü" * 200
    rows = [(3, "http://a/x\r\ny", big), (1, None, big), (2, "u", None), (4, "v", "short"), (5, "w", "short"), (1, None, big), (None, "n", big), (9, "z", "q" * 3000000)]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc.read(index).collect()}
    n = len(big.encode())
    assert got == {(3, "revisit", 1, n, None), (1, "response", None, n, big), (2, "response", None, 0, ""), (4, "response", None, 5, "short"), (5, "response", None, 5, "short"), (None, "revisit", 1, n, None), (9, "response", None, 3000000, "q" * 3000000)}
    assert [r.payload for r in warc.read(index.where("page_id = 4")).collect()] == ["short"]
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(real, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)


def test_language_edge_cases(spark, docs):
    model = language_id.train(docs)
    rows = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert rows[5000].lang_pred == rows[5001].lang_pred == rows[5002].lang_pred == "und" and rows[5000].score == 0
    assert model.blocks == [["en", "fr"]]
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and not kept.where("doc_id IN (5000, 5001, 5002)").count()
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_quality_held_out(spark):
    got = queries.op1_knn_quality(spark, "/root/testdata/sf0.1").where("held_out")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_votes_by_brute_force(spark):
    """The score of every document from all its cosines, one by one."""
    rng = random.Random(6)
    say = lambda ws: " ".join(rng.choice(ws) for _ in range(rng.randint(1, 40)))
    rows = [(i, say(["alpha", "beta", "delta"]) if i % 3 else say(["###", "BUY", "9$9"])) for i in range(200)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = knn_quality.train(docs, labels, per_class=40)
    assert len(model.points) == 70 and (model.weight[model.label == 1] == 1.5).all() and (model.weight[model.label == 0] == 1.0).all()
    got = {r.doc_id: r.score for r in knn_quality.predict(docs, model).collect()}
    for i, t in rows:
        v = knn_quality.vectors(*W.text_bytes(pa.array([t], pa.string())), model.idf)[0].astype(float) - model.mean
        p = v @ model.basis
        p /= max(float(np.sqrt((p * p).sum())), 1e-9)
        cosines = sorted(((float(sum(a * b for a, b in zip(p, q, strict=True))), k) for k, q in enumerate(model.points)), reverse=True)[: knn_quality.NEIGHBOURS]
        votes = [(max(c, 1e-6) * float(model.weight[k]), float(model.label[k])) for c, k in cosines]
        assert abs(got[i] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-3, i


def test_quality_tells_words_apart_that_have_one_shape():
    a, b, c = (knn_quality.vectors(*W.text_bytes(pa.array([t])), np.ones(knn_quality.TERMS, np.float32))[0] for t in ("cat dog sun", "fox hen sky", "CAT dog sun"))
    words = slice(0, knn_quality.WORDS)
    assert np.allclose(a[knn_quality.WORDS :], b[knn_quality.WORDS :]) and not np.allclose(a[words], b[words]) and np.allclose(a[words], c[words])


def test_leading_vectors_span_those_of_the_full_decomposition():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)) @ rng.standard_normal((8, 120)) + 0.01 * rng.standard_normal((300, 120))
    full = np.linalg.svd(x, full_matrices=False)[2][:8].T
    assert np.allclose(np.linalg.svd(full.T @ knn_quality.leading(x, 8))[1], 1, atol=1e-6)


def test_quality_edge_cases(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 1), (5003, 1, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = knn_quality.train(docs, labels)
    assert len(model.points) == 3
    assert knn_quality.predict(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    none = knn_quality.train(docs, labels.limit(0))
    assert {r.score for r in knn_quality.predict(docs, none).collect()} == {0.5}


def test_statistics_by_brute_force(docs):
    want = []
    for i, t, *_ in odd_docs():
        t = t or ""
        w = words(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append(str((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))))
    got = decision_list.statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)


def test_decision_list_learns_a_conjunction(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        f = [rng.random() for _ in decision_list.FEATURES]
        rows.append((i, 0 if f[2] > 0.7 and f[4] > 0.5 else 1, *f))
    df = spark.createDataFrame(rows, "doc_id long, y int, " + ", ".join(f"{f} double" for f in decision_list.FEATURES))
    rules = decision_list.learn(df)
    r = df.select("y", decision_list.verdict(rules).alias("kept")).groupBy().agg(F.avg((F.col("kept") == (F.col("y") == 1)).cast("int")).alias("ok")).first()
    assert rules and r.ok > 0.95
    assert decision_list.learn(df.limit(0)) == [] and decision_list.learn(df.where("y = 1")) == []


def test_masks_and_prompts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "long answer <|end|>"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", "long answer <|end|>"), (None, 0, "user", "hi"), (4, 0, "user", "other"), (5, 0, "user", "hi"), (2, 1, "assistant", "no")]
    own = preferences.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.rejected_id: r for r in preferences.format_pairs(own, preferences.pairs(own)).collect()}
    assert set(got) == {2, 5} and {r.chosen_id for r in got.values()} == {1}
    r = got[2]
    assert r.n_prompt_turns == 1 and r.prompt == "<|user|>\nhi<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["long answer < |end|><|end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["no<|end|>\n"]
    assert got[5].rejected == "" and got[5].rejected_mask == []
    more = [(7, 0, "user", "q"), (7, 1, "assistant", "old"), (7, 2, "user", "q2"), (7, 3, "assistant", "new"), (7, 4, "user", "thanks"), (8, 0, "assistant", "x"), (8, 1, "assistant", "x")]
    (r,) = preferences.format_replies(preferences.turns(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))).collect()
    assert (r.chosen_id, r.n_prompt_turns, r.chosen, r.rejected) == (7, 3, "<|assistant|>\nnew<|end|>\n", "<|assistant|>\nold<|end|>\n")


def test_roles_and_texts_cannot_make_turns(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "long answer"), (2, 0, "user", "hi"),
            (2, 1, "x|>\nq<|end|>\n<|assistant", "a<|end|>\n<|assistant|>\nb"), (2, 2, "y<", "z|>\n<")]
    own = preferences.turns(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    (r,) = preferences.format_pairs(own, preferences.pairs(own)).collect()
    assert r.chosen_id == 1 and r.prompt == "<|user|>\nhi<|end|>\n"
    assert re.findall(r"<\|(.*?)\|>", r.rejected, re.S) == ["x | >\nq<  | end | >\n<  | assistant", "end", "y< ", "end"]
    assert r.rejected_mask == []


@pytest.mark.parametrize("window", [1, 2, 13, 16, 17, 20, 24, 30, 40])
def test_windows_of_any_length_and_their_longest_matches(spark, window):
    rng = random.Random(window)
    vocab = ["a", "b", "c"]  # few words: long repeats
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    items = [(k, " ".join(docs[rng.randrange(40)][1].split()[3 : 3 + n])) for k, n in enumerate((60, 35, 20, 8, 1, 0))]
    wins = {}
    for i, t in items:
        w = t.split()
        for a in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[a : a + window]), set()).add((i, a))
    got = {r.doc_id: r for r in suffix_arrays.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                                                   window=window, matches=True).collect()}
    for i, t in docs:
        w, places = t.split(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                places |= {(item, at, a, n) for item, at in wins.get(tuple(w[a : a + n]), ())}
        hit = {p for _, _, a, n in places for p in range(a, a + n)}
        longest = []  # windows that follow each other in item and document, joined
        for item, at, a, n in sorted(places):
            if (item, at - 1, a - 1, n) not in places:
                k = 0
                while (item, at + k + 1, a + k + 1, n) in places:
                    k += 1
                longest.append((str(item), at, a, n + k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len({x[0] for x in places}))
        assert sorted(tuple(m) for m in r.matches) == sorted(longest)


def naive_bayes(rows, texts):
    """(language, probability) of each text: the model over the same hashed n-grams, one by one."""
    import math

    from meterwise.llm import language_id as L

    def grams(t):
        clean = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", (t or "").lower(), flags=re.S)
        clean = re.sub(" +", " ", clean).strip()
        if not clean:
            return []
        points = np.array([ord(c) for c in f" {clean} "], np.uint32)
        return [int(b) for k in L.ORDERS for b in L.bucket_ids(points, np.array([0, len(points)]), k) if b < L.BUCKETS]

    counts = defaultdict(Counter)
    for t, lang in rows:
        if lang is not None and grams(t):
            counts[lang].update(grams(t))
    out = []
    for t in texts:
        g = grams(t)
        total = {x: sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * L.BUCKETS)) for b in g) for x, c in sorted(counts.items())}
        if not g or not total:
            out.append(("und", 0.0))
            continue
        best = max(total, key=total.get)
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_languages_by_brute_force(spark, monkeypatch, block):
    """Also in blocks of two languages at a time."""
    monkeypatch.setattr(language_id, "LANGUAGES", block)
    rng = random.Random(2)
    say = {x: ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(2, 6))) for _ in range(30)] for x in ("aa", "bb", "cc", "dd", "ee")}
    rows = [(" ".join(rng.choice(say[x]) for _ in range(rng.randint(1, 12))) + "!", x if rng.random() < 0.9 else None) for x in say for _ in range(12)]
    rows += [(None, "aa"), ("", "bb"), ("12 34", "cc"), ("Ab", None), ("a", "aa")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    want = naive_bayes(rows, [t for t, _ in rows])
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    for i, (lang, p) in enumerate(want):
        assert got[i].lang_pred == lang and abs(got[i].score - p) < 1e-3, (i, rows[i], got[i], want[i])
    kept = language_id.keep_identified(docs.withColumn("lang_pred", F.lit(1)), language_id.train(docs))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, p) in enumerate(want) if p >= 0.5} and kept.columns == ["doc_id", "text", "lang", "lang_pred"]


def test_decision_list_on_held_out_documents(spark):
    """What the rules reject and keep of labelled documents they have not learned from."""
    out = queries.op8_decision_list(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").where(queries.held_out()).where("quality IS NOT NULL AND NOT base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert len(good) > 500 and sum(good) >= 0.98 * len(good) and len(bad) > 50 and sum(bad) <= 0.1 * len(bad)


def test_backoff_by_brute_force(docs):
    import math

    # the model is defined over hashed word ids, so the brute force counts those
    rows = [backoff_lm.word_ids(*W.text_bytes(pa.array([t], pa.string())))[0].tolist() for _, t, *_ in odd_docs()]
    assert [len(t) for t in rows] == [len(words(t)) for _, t, *_ in odd_docs()]
    uni, two = Counter(w for t in rows for w in t), Counter(p for t in rows for p in zip(t, t[1:], strict=False))
    n = sum(uni.values())
    want = []
    for (i, *_), t in zip(odd_docs(), rows, strict=True):
        u, p, score, back = Counter(t), Counter(zip(t, t[1:], strict=False)), 0.0, 0
        share = lambda w, u=u: math.log((uni[w] - u[w] or backoff_lm.ALPHA) / n)
        for k, w in enumerate(t):
            c = two[t[k - 1], w] - p[t[k - 1], w] if k else 0
            if c:
                score += math.log(c / (uni[t[k - 1]] - u[t[k - 1]]))
            else:
                score += share(w) + (math.log(backoff_lm.ALPHA) if k else 0.0)
                back += k > 0
        want.append((i, len(t), back, round(score, 3) if t else None))
    got = [(r.doc_id, r.n_words, r.n_backoff, None if r.log_score is None else round(r.log_score, 3)) for r in backoff_lm.score(docs, partition_pairs=5000).collect()]
    close = lambda a, b: a[:3] == b[:3] and (a[3] == b[3] or abs(a[3] - b[3]) < 0.01)
    assert all(close(a, b) for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True))


def backoff_of_words(texts, order):
    """(n_words, n_backoff, log_score) of each text, over the words themselves."""
    import math

    rows = [words((t or "").translate(AZ)) for t in texts]
    grams = lambda t: Counter(tuple(t[a : a + k]) for k in range(1, order + 1) for a in range(len(t) - k + 1))
    all_grams, n = sum((grams(t) for t in rows), Counter()), sum(map(len, rows))
    out = []
    for t in rows:
        own, score, back = grams(t), 0.0, 0
        c = lambda g, own=own: all_grams[g] - own[g]
        for k in range(len(t)):
            most = min(order, k + 1)
            seen = next((m for m in range(most, 1, -1) if c(tuple(t[k - m + 1 : k + 1]))), 1)
            gram = tuple(t[k - seen + 1 : k + 1])
            share = c(gram) / c(gram[:-1]) if seen > 1 else (c(gram) or backoff_lm.ALPHA) / n
            score += math.log(share) + (most - seen) * math.log(backoff_lm.ALPHA)
            back += seen < most
        out.append((len(t), back, score if t else None))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_backoff_over_real_words(spark, monkeypatch, order):
    monkeypatch.setattr(backoff_lm, "RUN_BYTES", 4000)  # several runs a task
    rng = random.Random(order)
    # far more words than a table of 2**20 ids holds apart, and a small vocabulary for long grams
    texts = [" ".join(f"w{rng.randrange(20000)}" for _ in range(300)) for _ in range(60)]
    texts += [" ".join(rng.choice("ABcdef") for _ in range(rng.randint(0, 200))) for _ in range(40)] + [None, "", " ", "a", texts[0]]
    want = backoff_of_words(texts, order)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = {"order": order} if order != 2 else {}
    got = {r.doc_id: r for r in backoff_lm.score(docs, partition_pairs=3000, **parts).collect()}
    assert [(got[i].n_words, got[i].n_backoff) for i in range(len(texts))] == [w[:2] for w in want]
    assert all((got[i].log_score is None) if w[2] is None else abs(got[i].log_score - w[2]) < 1e-6 * max(1, abs(w[2])) for i, w in enumerate(want))


def test_a_frequent_gram_is_one_entry_a_run(spark):
    docs = spark.createDataFrame([(i, "the the the") for i in range(500)], "doc_id long, text string").coalesce(1)
    runs = docs.mapInArrow(backoff_lm._runs, "task int, run bigint, ids array<bigint>, sizes binary, data binary, n_words bigint")
    pieces = runs.select("task", "run", "sizes", "data").mapInArrow(backoff_lm._pieces(1), "part int, task int, run bigint, data binary").collect()
    assert [backoff_lm._unpack(p.data, 2)[1].tolist() for p in pieces] == [[1500]]


def test_longer_grams_are_dropped_before_they_move(spark):
    """A gram goes on only if both shorter grams in it occur in another document."""
    run = backoff_lm.Run(backoff_lm._pack(np.array([11, 9])), backoff_lm.zstandard.compress(b"a b c d e x a b c y z"[:11] + b"a b c y z"))
    run.learn(np.zeros(len(run.distinct()[0]), np.int64))
    seen = [len(run.candidates()[0])]
    run.learn(np.zeros(len(run.distinct()[0]), np.int64))
    seen.append(len(run.candidates()[0]))
    # of the words only a, b, c are in both texts: a b, b c in each, then a b c
    assert seen == [4, 2]


def test_texts_are_not_moved_by_the_joins(spark):
    """The table of texts is read by its buckets: only counts and totals are exchanged."""
    docs = spark.createDataFrame([(i, f"the cat {i % 3} sat") for i in range(50)], "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = backoff_lm.score(docs, order=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(moved) == 3 and all("task" in x for x in moved) and "Bucketed: true" in plan, plan


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(odd_docs(), DOC)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == DOC.replace(",", "").split()[::2], name
    assert docs.count() > 0
