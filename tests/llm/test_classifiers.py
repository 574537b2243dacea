import random
import time
import zlib

import numpy as np
from samples import ODD, words
from fluxlane.llm import catalog, language, quality, toxicity
from fluxlane.llm.common import sampled_texts


def held(i, mod, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod == rest


def labelled(make_docs, spark, bad):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        marked = i % 4 == 0
        rows.append((i, bad(rng, words(rng, 40)) if marked else words(rng, 40) + "."))
        labels.append((i, int(not marked), int(marked)))
    return make_docs(rows), spark.createDataFrame([*labels, (9999, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), {i: m for i, m, _ in [(r[0], r[0] % 4 == 0, 0) for r in rows]}


def test_toxicity_finds_marked_words_of_held_out_documents(spark, make_docs):
    docs, labels, toxic = labelled(make_docs, spark, lambda rng, t: t + " wretch " + t)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 240 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id, 4, 2) for r in got)
    assert all(r.predicted == toxic[r.doc_id] for r in got if r.held_out)


def test_toxicity_takes_whole_texts_and_no_other_column(spark, make_docs):
    docs, labels, _ = labelled(make_docs, spark, lambda rng, t: t + " wretch " + t)
    model = toxicity.fit(docs, labels)
    rng = random.Random(3)
    plain = words(rng, 40)
    filler = (plain + " ") * 8000
    got = {r.doc_id: r.score for r in toxicity.score(make_docs([(1, plain), (2, filler + " wretch"), (3, filler)]), model).collect()}
    assert got[2] > got[3]
    assert set(toxicity.ngram_buckets(filler)) | set(toxicity.ngram_buckets("wretch")) <= set(toxicity.ngram_buckets(filler + " wretch")) | set(toxicity.ngram_buckets(" wretch "))


def plain_buckets(text):
    """The buckets of a text's 3- to 6-grams, character by character."""
    codes, full, out = [ord(c) for c in f" {(text or '').lower()} "], (1 << 32) - 1, set()
    for n in (3, 4, 5, 6):
        for at in range(len(codes) - n + 1):
            h = (n * 0x01000193) & full
            for k in range(n):
                h = ((h ^ codes[at + k]) * int(toxicity._MIX[k])) & full
                h ^= h >> 15
            out.add(h >> 12)
    return out


def test_toxicity_query_equals_brute_force(spark, tmp_path, make_docs):
    docs, labels, _ = labelled(make_docs, spark, lambda rng, t: t + " wretch " + t)
    odd = make_docs([(None if i is None else 10_000 + i, t) for i, t in ODD if i not in (None, 3, 4)])
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and r.toxic is not None and not held(r.doc_id, 4, 2)}
    ids = sorted(marks)
    sets = {i: plain_buckets(texts[i]) for i in ids}
    n1 = sum(marks.values())
    ratio = {}
    for b in set().union(*sets.values()):
        c = [sum(b in sets[i] for i in ids if marks[i] == y) for y in (0, 1)]
        r = np.log((c[1] + 1) / (n1 + 2)) - np.log((c[0] + 1) / (len(ids) - n1 + 2))
        if sum(c) >= 5 and abs(r) >= 1:
            ratio[b] = r
    used = sorted(ratio)
    row = lambda s: np.array([ratio[b] * (b in s) for b in used])
    unit = lambda x: x * (10 / np.sqrt(max((x**2).sum(), 1e-12)))
    x, y = np.stack([unit(row(sets[i])) for i in ids]), np.array([marks[i] for i in ids])
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, 101):
        miss = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g = np.append(x.T @ miss + 0.01 * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    got = catalog.op1_toxicity(spark, str(tmp_path)).collect()
    every = docs.unionByName(odd).collect()
    assert len(got) == len(every)
    for r in got:
        z = b + unit(row(plain_buckets(next(e.text for e in every if e.doc_id == r.doc_id)))) @ w
        assert np.isclose(r.score, 1 / (1 + np.exp(-z)), atol=1e-4) and r.predicted == (r.score >= 0.3)


def test_toxicity_without_labels_is_zero(spark, make_docs):
    docs, labels, _ = labelled(make_docs, spark, lambda rng, t: t)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("doc_id < 0"))).collect()} == {0.0}


def test_packed_buckets_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 500, 40_000, 1 << 20):
        buckets = np.sort(rng.permutation(1 << 20)[:n]).astype(np.int32)
        assert np.array_equal(toxicity.unpacked(toxicity.packed(buckets)), buckets) and len(toxicity.packed(buckets)) <= (1 << 17) + 1


def test_repeated_labels_and_texts_add_no_rows(spark, make_docs):
    docs = make_docs([(1, "b"), (1, "a"), (2, "c")] * 50)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)] * 50, "doc_id long, label int")
    assert sorted(map(tuple, sampled_texts(docs, labels, 10, 1).collect())) == [("a", 0), ("c", 1)]


def test_ngrams_match_brute_force_over_blocks(monkeypatch):
    text = "ab\U0001f600cdéfg" * 30
    whole = toxicity.ngram_buckets(text)
    monkeypatch.setattr(toxicity, "BLOCK", 11)
    assert np.array_equal(whole, toxicity.ngram_buckets(text))


def test_odd_rows_are_scored(spark, make_docs):
    docs, labels, _ = labelled(make_docs, spark, lambda rng, t: t + " wretch")
    none = labels.filter("doc_id < 0")
    for op in (toxicity, quality):
        for model in (op.fit(docs, labels), op.fit(docs, none), op.fit(docs.filter("doc_id < 0"), labels)):
            got = op.score(make_docs(ODD), model).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
            same = [r.score for r in got if r.doc_id == 4]
            assert same[0] == same[1]
            assert op.score(make_docs([]), model).collect() == []
    blank = {r.doc_id: r.score for r in quality.score(make_docs(ODD), quality.fit(docs, labels)).collect()}
    assert blank[1] == blank[2] == blank[6] == blank[7] == 0


def test_quality_of_held_out_documents(spark, make_docs):
    docs, labels, low = labelled(make_docs, spark, lambda rng, t: "\n".join(w.upper() + "!!" for w in t.split()[:20]))
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert all(r.predicted == (not low[r.doc_id]) and r.held_out == held(r.doc_id, 5, 0) for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths, transition = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    emission = rng.normal(size=(8, 2))
    single, pairs, z = quality.marginals(emission, lengths, transition)
    at = 0
    for c, n in enumerate(lengths):
        total, one, two = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2**n):
            s = [(code >> k) & 1 for k in range(n)]
            p = np.exp(sum(emission[at + k, s[k]] for k in range(n)) + sum(transition[a, b] for a, b in zip(s, s[1:])))
            total += p
            for k in range(n):
                one[k, s[k]] += p
            for a, b in zip(s, s[1:]):
                two[a, b] += p
        assert np.allclose(single[at : at + n], one / total) and np.allclose(pairs[c], two / total) and np.isclose(z[c], np.log(total))
        at += n


def test_gradient_equals_finite_differences_of_the_loss():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 6])
    features, goal = rng.normal(size=(13, 5)), np.array([1.0, 0.0, 0.3, 1.0])
    weight = np.concatenate([x / x.sum() for x in (rng.random(n) for n in lengths)])
    theta = rng.normal(size=9)
    loss = lambda t: quality.share_gradient(features, lengths, weight, goal, t)[0]
    grad = quality.share_gradient(features, lengths, weight, goal, theta)[1]
    for k in range(9):
        step = np.zeros(9)
        step[k] = 1e-5
        assert np.isclose(grad[k], (loss(theta + step) - loss(theta - step)) / 2e-5, rtol=1e-4, atol=1e-7)
    # the score itself, over all labellings of a chain
    odds, t, n = features[1:5] @ theta[:-4], theta[-4:].reshape(2, 2), 4
    total = share = 0.0
    for code in range(2**n):
        y = [code >> k & 1 for k in range(n)]
        p = np.exp(sum(odds[k] * y[k] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total, share = total + p, share + p * sum(weight[1 + k] * y[k] for k in range(n))
    assert np.isclose(quality.share_gradient(features[1:5], np.array([4]), weight[1:5], np.array([1.0]), theta)[0], -np.log(share / total))


def test_long_chains_equal_short_ones():
    rng = np.random.default_rng(4)
    for scale in (1, 50):
        odds, t = rng.normal(size=700) * scale, rng.normal(size=(2, 2))
        want = quality.marginals(np.stack([np.zeros(700), odds], 1), np.array([700]), t)[0][:, 1]
        assert np.allclose(quality.long_marginals(odds, t), want, atol=1e-9)
    assert quality.long_marginals(np.array([0.3]), t)[0] == 1 / (1 + np.exp(-0.3))


def test_lines_of_mixed_documents_are_told_apart(spark, make_docs):
    docs, labels, low = labelled(make_docs, spark, lambda rng, t: "\n".join(w.upper() + "!!" for w in t.split()[:20]))
    rng = random.Random(9)
    rows = [(r.doc_id, r.text if low[r.doc_id] else "\n".join(words(rng, 8).capitalize() + "." for _ in range(12))) for r in docs.collect()]
    model = quality.fit(make_docs(rows), labels)
    hits = []
    for k in range(40):
        good = [words(rng, 8).capitalize() + "." for _ in range(10)]
        junk = [words(rng, 1).upper() + "!!" for _ in range(10)]
        p, _ = quality.line_marginals("\n".join(good + junk if k % 2 else junk + good), model)
        p = p if k % 2 else np.roll(p, 10)
        hits.append([(p[:10] >= 0.5).mean(), (p[10:] < 0.5).mean()])
    assert (np.mean(hits, 0) >= 0.9).all() and np.min(hits) > 0


def test_texts_of_very_many_lines_take_linear_time():
    model = (np.random.default_rng(1).normal(size=3 * quality.N_BASE + 1), np.zeros((2, 2)))
    text = "A line of words.\n" * 200_000
    began = time.perf_counter()
    assert 0 <= quality.score_texts([text], model)[0] <= 1 and time.perf_counter() - began < 30
    assert len(quality.stretches(200_000)) == quality.TRAIN_LINES and quality.stretches(200_000)[-1] == 199_999 and quality.stretches(5).tolist() == [0, 1, 2, 3, 4]


def test_query_equals_brute_force_of_the_score(spark):
    """op2 over a table: each document's score from sums over all labellings, for documents of few lines."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights, t = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts, seen = {r.doc_id: r.text for r in docs.collect()}, 0
    got = catalog.op2_quality_classifier(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        x, n = quality.line_features(texts[r.doc_id])
        assert r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3)
        if 0 < len(n) <= 8:
            odds, total, share = x @ weights, 0.0, 0.0
            for code in range(2 ** len(n)):
                y = [code >> k & 1 for k in range(len(n))]
                p = np.exp(sum(o * s for o, s in zip(odds, y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
                total, share = total + p, share + p * sum(c * s for c, s in zip(n, y)) / n.sum()
            assert np.isclose(r.score, share / total, atol=1e-6)
            seen += 1
    assert seen > 20


def test_line_features_by_hand():
    x, n = quality.line_features("Ab cd cd.\n\nXY!!\nXY!!")
    assert n.tolist() == [9, 4, 4]
    assert np.isclose(x[1, 3], 1) and x[1, 13] == 0 and x[2, 13] == 1  # all letters upper; the last line is a repeat
    assert np.isclose(x[0, 11], 1) and np.isclose(quality.line_features("Ab cd cd")[0][0, 11], 2 / 3)  # two distinct words of three
    assert np.array_equal(x[1, 14:28], x[0, :14]) and np.array_equal(x[1, 28:42], x[2, :14])


TEXTS = {"xx": "lo mi ra lo mi ra sol fa lo mi", "yy": "tek zur bok tek zur vok pek tur", "zz": "ñandú über çelik ñandú über"}


def test_language_of_held_out_documents(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(TEXTS[k].split()) for _ in range(12)), k) for i in range(120) for k in [list(TEXTS)[i % 3]]]
    rows += [(500 + i, "tek zur", None) for i in range(5)]
    docs = make_docs(rows)
    model = language.fit(docs)
    assert model[0] == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if k) and all(0 <= r.score <= 1 for r in got.values())
    odd = language.identify(make_docs(ODD), model).collect()
    assert len(odd) == len(ODD) and {r.lang_pred for r in odd if r.doc_id in (1, 2, 6, 7)} == {"und"}
    assert language.identify(make_docs([]), language.fit(make_docs([]))).collect() == []
    assert {r.lang_pred for r in language.identify(docs, language.fit(make_docs([]))).collect()} == {"und"}


def test_language_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    two, one, none = (x.astype(np.int32) for x in language.vectors())

    def plain(text):
        total, row = np.zeros(language.DIMENSIONS), [language.letter_of()[ord(c)] for c in f" {(text or '').lower()} "]
        for a, b, c in zip(row, row[1:], row[2:]):
            if a or b:
                total += two[a] * one[b] * none[c]
        return total

    vectors = [plain(r.text) for r in docs]
    sums = {}
    for r, v in zip(docs, vectors):
        if r.lang is not None and not held(r.doc_id, 4, 2) and v.any():
            sums[r.lang] = sums.get(r.lang, 0) + np.rint(v * (4096 / np.linalg.norm(v)))
    want = {}
    for r, v in zip(docs, vectors):
        cosines = [(v @ s / np.linalg.norm(v) / np.linalg.norm(s), n) for n, s in sorted(sums.items())] if v.any() else []
        want[r.doc_id] = max(cosines, key=lambda x: x[0]) if cosines else (0.0, "und")
    got = catalog.op6_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.lang_pred == want[r.doc_id][1] and np.isclose(r.score, max(0, want[r.doc_id][0])) and r.held_out == held(r.doc_id, 4, 2)


def test_a_rare_language_is_learned(make_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(TEXTS["xx"].split()) for _ in range(12)), "xx") for i in range(3000)]
    rows += [(5000 + i, " ".join(rng.choice(TEXTS["zz"].split()) for _ in range(12)), "zz") for i in range(3)]
    assert language.fit(make_docs(rows), bound=50)[0] == ["xx", "zz"]


def test_bundles_equal_sums_of_bound_letters():
    two, one, none = language.vectors()
    text = " abc "
    rows = [language.letter_of()[ord(c)] for c in text]
    want = sum(two[a].astype(int) * one[b] * none[c] for a, b, c in zip(rows, rows[1:], rows[2:]))
    assert np.array_equal(language.bundle(*language.trigrams("abc")), want)
    assert np.array_equal(np.roll(none, 1, 1), one)


def test_trigrams_over_blocks(monkeypatch):
    text = "ñandú über tek zur bok " * 20
    whole = language.trigrams(text)
    monkeypatch.setattr(language, "BLOCK", 13)
    parts = language.trigrams(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
