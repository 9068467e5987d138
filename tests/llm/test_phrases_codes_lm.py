"""Phrase collocations, vector codes and the hidden Markov model against brute force."""

import datetime
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import hmm_lm, phrases, vector_codes

CLASH = "lang string, text string, doc_id long, f long, phrase string, words int, block long, row long, n long, id int"


def brute_phrases(rows, most=4, least=30, share=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) >= 2}
    out = {}
    for (lang, w), a in found.items():
        if any(l2 == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (l2, v), b in found.items()):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, l_, r_, n[lang], -s) for lang, best in out.items() for r, (s, a, p, l_, r_) in enumerate(sorted(best)[:top], 1))


def test_phrases_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["a", "B", "b", "of", "the", "été", "É", "x y", "日本", "q"]
    rows = []
    for i in range(300):
        parts = [str(rng.choice(words, p=np.array([8, 2, 8, 6, 6, 2, 1, 1, 1, 1]) / 36)) + str(rng.choice([" ", "  ", "\t", ".", " , ", "\n", "\r\x0b"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(int(rng.integers(0, 60)))]
        rows.append((["en", "fr", None, "und"][i % 4], "".join(parts) + " New York City "))
    rows += [("en", None), ("en", ""), (None, "  . "), ("en", "deep blue sea " * 700), ("", "p q " * 40)]
    rows += [rows[5]] * 3
    docs = spark.createDataFrame([(*r, None, 1, "x", 2, 3, 4, 5, 6) for r in rows], CLASH).repartition(5)
    got = [tuple(r) for r in phrases.collocations(docs, least=12, top=25).collect()]
    want = brute_phrases(rows, least=12, top=25)
    assert sorted(got) == want and len(want) > 60
    assert not phrases.collocations(docs.limit(0)).collect()
    assert not phrases.collocations(docs.where("text is null")).collect()


def test_parts_of_a_long_text_hold_each_ngram_once(spark, monkeypatch):
    text = " ".join(f"w{i % 7}{'.' if i % 11 == 0 else ''}" for i in range(3000))
    whole = brute_phrases([("en", text)], least=5)
    monkeypatch.setattr(phrases, "UNIT", 97)
    for n in (1, 2, 3, 4):
        f = Counter()
        batch = __import__("pyarrow").RecordBatch.from_arrays([["en"], [text]], ["lang", "text"])
        for unit, _ in phrases.units(iter([batch]), n):
            at = unit.ngrams(n)
            found, _, counts = unit.counted(at, n)
            f.update(dict(zip(found.to_pylist(), counts.tolist(), strict=True)))
        pieces = [p.split() for p in re.split("[.]", text)]
        assert f == Counter(" ".join(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1))
    assert whole


def test_products_beyond_64_bits(spark, tmp_path):
    counts = spark.createDataFrame([("en", None, 0, 10**18), ("en", "a", 1, 9 * 10**17), ("en", "b", 1, 8 * 10**17), ("en", "a b", 2, 7 * 10**17)], "lang string, phrase string, words int, f long")
    keep = phrases.phrase_counts
    phrases.phrase_counts = lambda *a: counts
    try:
        (row,) = phrases.collocations(spark.createDataFrame([("en", "")], "lang string, text string")).collect()
    finally:
        phrases.phrase_counts = keep
    assert row.score == 2000000 * 7 * 10**17 // (17 * 10**17) and row.n == 10**18


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    kept = sorted(((i, label, v + [0] * (width * parts - len(v))) for i, label, v in kept), key=lambda r: (r[0] is None, r[0], r[2]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, v in kept:
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[n]) for c in zip(*own[n], strict=True)] if n in own else e for n, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, label, v in kept]
    errors = [sum(d for d, _ in c) for _, _, c in coded]
    by = Counter()
    for (_, label, _), e in zip(coded, errors, strict=True):
        by[label] += e
    return sorted((repr(i), "".join(f"{n:02x}" for _, n in c), e, by[label], sha) for (i, label, c), e in zip(coded, errors, strict=True))


@pytest.mark.parametrize("kind", ["random", "ties", "few", "ragged"])
def test_codes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n = {"random": 200, "ties": 200, "few": 9, "ragged": 80}[kind]
    make = {"random": lambda: rng.normal(0, 0.3, 32), "ties": lambda: rng.integers(-1, 2, 32) / 256, "few": lambda: rng.normal(0, 2, 16), "ragged": lambda: rng.normal(0, 1, int(rng.integers(0, 37)))}[kind]
    rows = [(int(i), None if i % 5 == 0 else int(i % 3), [float(np.float32(x)) for x in make()]) for i in rng.permutation(n)]
    rows += [(None, 1, rows[0][2]), rows[1], rows[1], (500, 1, None), (501, 1, [1.0] * 15 + [None]), (502, None, [float("nan")] * 16), (503, 2, [float("-inf")] * 16)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, code string, error int").repartition(4)
    got = vector_codes.compress(docs)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in map(tuple, got.collect())) == brute_codes(rows)


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert not vector_codes.compress(empty).collect()
    assert not vector_codes.compress(spark.createDataFrame([(1, 1, None)], empty.schema)).collect()
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, 1, [1e30] * 16)], empty.schema)).collect()


def test_annulus_is_inclusive():
    # Entries at exactly the same distance on either side of the annulus: the least number wins.
    for dims in (1, 2, 3):
        grid = np.array(list(itertools.product(range(-4, 5), repeat=dims)), np.int64)
        book = np.random.default_rng(dims).permutation(grid)[: min(64, len(grid))]
        codes, errors = vector_codes.Book(book).nearest(grid)
        d = ((grid[:, None, :] - book[None]) ** 2).sum(2)
        assert (errors == d.min(1)).all() and (codes == d.argmin(1)).all()


def brute_forward(model, classes):
    a, logs = model.start, 0.0
    for c in classes:
        a = (a @ model.steps) * model.emits[c]
        logs += math.log10(a.sum())
        a = a / a.sum()
    return logs


def brute_counts(model, classes):
    """Expected counts by the unscaled recursion over all pairs of states."""
    k, n = len(model.start), len(classes)
    a = [model.start]
    for c in classes:
        a.append((a[-1] @ model.steps) * model.emits[c])
    b = [np.ones(k)]
    for c in reversed(classes):
        b.insert(0, model.steps @ (model.emits[c] * b[0]))
    whole = a[-1].sum()
    emitted, steps = np.zeros_like(model.emits), np.zeros((k, k))
    for t in range(n):
        emitted[classes[t]] += a[t + 1] * b[t + 1] / whole
        steps += np.outer(a[t], model.emits[classes[t]] * b[t + 1]) * model.steps / whole
    return emitted, steps, a[0] * b[0] / whole


def some_model(k=3, c=12, seed=0):
    rng = np.random.default_rng(seed)
    return hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)


def test_recursions_equal_brute_force(monkeypatch):
    monkeypatch.setattr(hmm_lm, "CHUNK", 7)
    monkeypatch.setattr(hmm_lm, "SLICE", 30)
    rng, model = np.random.default_rng(2), some_model()
    sizes = np.array([1, 40, 7, 8, 3, 14, 90, 1, 21])
    classes = rng.integers(0, 12, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    chunks = hmm_lm.Chunks(starts, sizes)
    logs = model.log_likelihood(classes, chunks, len(sizes))
    texts = [classes[s : s + n] for s, n in zip(starts, sizes, strict=True)]
    assert np.allclose(logs, [brute_forward(model, t) for t in texts], atol=1e-10)
    emitted, steps, first, total = model.expected(classes, chunks)
    want = [brute_counts(model, t) for t in texts]
    assert np.allclose(emitted, sum(w[0] for w in want)) and np.allclose(steps, sum(w[1] for w in want)) and np.allclose(first, sum(w[2] for w in want))
    assert abs(total - logs.sum()) < 1e-9


def test_long_texts_are_exact():
    rng, model = np.random.default_rng(4), some_model(4, 30, 1)
    classes = rng.integers(0, 30, 20_001)
    got = model.log_likelihood(classes, hmm_lm.Chunks(np.array([0]), np.array([len(classes)])), 1)
    assert abs(got[0] - brute_forward(model, classes)) < 1e-6


def words_of(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_scores_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, " \t\n"), (None, "Zug zug ZUG Ärger"), (10**6 + 4, "a b " * 4000), (10**6 + 4, "a b " * 4000), (10**6 + 5, "  nie-gesehen")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("block", docs["doc_id"]).withColumn("words", docs["text"]).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = hmm_lm.score(docs, rounds=3).collect()
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, text in rows:
        if not fold(i):
            c.update([*words_of(text), None])
    n, v = sum(c.values()), len(c)
    base = lambda text: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words_of(text), None])
    key = lambda r: tuple(map(repr, r[:5]))
    want = sorted(((i, fold(i), len(words_of(t)) + 1, sum(1 for w in words_of(t) if c[w]) + (c[None] > 0), n, base(t)) for i, t in rows), key=key)
    got = sorted(map(tuple, out), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-6)
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_model_improves_and_one_state_is_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = hmm_lm.blocks(docs, "doc_id", "text")
    ready, totals = hmm_lm.counted(packed)
    model, path = hmm_lm.train(ready, totals, 4, 4)
    assert path == sorted(path) and path[-1] > path[0]
    again, path2 = hmm_lm.train(ready, totals, 4, 4)
    assert path == path2 and (model.emits == again.emits).all()
    assert np.allclose(model.emits.sum(0), 1) and np.allclose(model.steps.sum(1), 1)
    # The probabilities of a class's words sum to 1, half of the rare class for unknown ones.
    one, _ = hmm_lm.train(ready, totals, 1, 1)
    shares = totals["classes"] / totals["tokens"]
    assert np.abs(one.emits[:, 0] - shares).max() < 0.01


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert not hmm_lm.score(spark.createDataFrame([], schema)).collect()
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    out = hmm_lm.score(spark.createDataFrame([(i, "a b") for i in held], schema)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out] == [(3, 0, 0, 0.0)] * 3
    assert all(math.isfinite(r.score) for r in out)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("x", datetime.date(2020, 1, 1), "a b a"), (None, None, "b")], "k string, d date, t string")
    assert {r.k for r in hmm_lm.score(docs, "k", "t", rounds=1).collect()} == {"x", None}
    assert {r.d for r in hmm_lm.score(docs, "d", "t", rounds=1).collect()} == {datetime.date(2020, 1, 1), None}
