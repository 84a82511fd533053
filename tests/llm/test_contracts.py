"""The registered queries on the smallest tables, against SQL, brute force or held-out rows."""

import collections
import glob
import hashlib
import itertools
import math
import os
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontaminate, entry, jaccard_join, language_id, licenses, lm_scoring, mixing, quality_classifier, quality_rules, substring_dedup
from siltstone.llm import words as W
from siltstone.runtime import materialise, table

QUERIES = entry.queries()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in table(spark, sf, "documents").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf):
    return {r.doc_id: r for r in table(spark, sf, "labels").collect()}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    norm = lambda rows: sorted(tuple("None" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(entry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(con.sql(f"SELECT {', '.join(cols)} FROM want").fetchall())


def test_language_model(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op1_lm_scoring"](spark, sf).collect()}
    toks = {i: [x.encode() for x in WORD.findall(lower(d.text))] + [b""] for i, d in docs.items()}
    count = collections.Counter(x for i, w in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in w)
    n, v = sum(count.values()), len(count)
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks[i]), sum(count[x] > 0 for x in toks[i]), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in toks[i])) < 1e-6
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _vocabulary(words, counts):
    tail = collections.defaultdict(lambda: [0, 0])
    for x, c in zip(words[1:], counts[1:].tolist(), strict=True):
        k = int(lm_scoring.suffix([x])[0])
        tail[k][0] += c
        tail[k][1] += 1
    return lm_scoring.Vocabulary(words, counts, dict(tail), int(counts.sum()), len(words))


def test_language_model_is_a_distribution(monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 12)
    words = [b"", *(f"w{i}".encode() for i in range(30))]
    v = _vocabulary(words, np.arange(60, 60 - len(words), -1))
    net = lm_scoring.Network(v)
    lm_scoring.train_on(iter([v.encode(b" ".join(words[1:9]))[0]] * 40), net, v, 0.02)
    one = lambda i: np.exp(lm_scoring.score_documents([np.array([i], np.uint16)], net, v)[0])
    assert abs(sum(one(i) for i in range(v.symbols)) - 1) < 1e-4
    mass = collections.Counter()
    for x in words[1:]:
        s, at, _ = v.encode(x)
        if s[0] >= v.head:
            mass[int(s[0])] += (v.counts[at[0]] + 1) * np.exp(-v.tail_size[int(s[0]) - v.head])
    assert mass and all(m < 1 for m in mass.values())


def test_language_model_carries_its_state(monkeypatch):
    """Documents of every length score as in one go, whatever shares their lines, and the gradient is the slope of the loss."""
    words = [b"", *(f"w{i}".encode() for i in range(50))]
    v = _vocabulary(words, np.arange(120, 120 - len(words), -1))
    net = lm_scoring.Network(v)
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, v.head, n), v.end).astype(np.uint16) for n in (0, 1, 15, 16, 17, 900, 33, 0, 250)]
    monkeypatch.setattr(lm_scoring, "LINES", 3)
    got = lm_scoring.score_documents(docs, net, v)
    for d, x in zip(docs, got.tolist(), strict=True):
        states, _ = net.run(np.concatenate(([v.end], d[:-1])).astype(np.int32)[:, None], np.zeros((1, lm_scoring.HIDDEN), np.float32), v.end)
        assert abs(net.output(states[:, 0], d, v)[0].sum() - x) < 1e-2
    inputs, target = np.concatenate(([v.end], docs[4][:-1])).astype(np.int32)[:, None], docs[4]

    def loss(net, grad=None):
        states, made = net.run(inputs, np.zeros((1, lm_scoring.HIDDEN), np.float32), v.end, True)
        out, ds = net.output(states[:, 0], target, v, grad)
        if grad is not None:
            net.backward(made, ds[:, None, :], grad)
        return -out.astype(np.float64).sum()

    grad = {}
    loss(net, grad)
    for name, g in grad.items():
        rows, g = g if isinstance(g, tuple) else (slice(None), g)
        full = np.zeros_like(net.p[name])
        full[rows] = g
        way = rng.normal(0, 1, full.shape).astype(np.float32)
        a, b = net.copy(), net.copy()
        a.p[name] += np.float32(1e-3) * way
        b.p[name] -= np.float32(1e-3) * way
        slope = (loss(a) - loss(b)) / 2e-3
        assert abs(slope - (full * way).sum()) < 0.02 * max(1.0, abs(slope)), name


def test_dictionary_is_cut_inside_a_step_of_ties(spark):
    counts = spark.range(5000).selectExpr("concat('w', id) AS word", "CASE WHEN id < 10 THEN 100L ELSE 3L END AS c")
    top = [r.c for r in lm_scoring.frequent(counts, 1000).collect()]
    assert 990 < len(top) <= 1000 and top.count(100) == 10
    assert 990 < lm_scoring.frequent(counts.filter("c = 3"), 1000).count() <= 1000
    assert lm_scoring.frequent(counts, 9000).count() == 5000 and lm_scoring.frequent(counts.limit(0), 9).count() == 0


def test_languages_of_held_out_documents(spark, sf, docs):
    got = QUERIES["op2_language_id"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_against_one_document_at_a_time():
    """EM over nested sets written out for single documents, which must not depend on their neighbours."""
    rng = np.random.default_rng(6)

    def fit(lik, pi):
        for _ in range(language_id.ROUNDS):
            r = lik * pi
            pi = (r / r.sum(1, keepdims=True)).mean(0)
        return pi, np.log((lik * pi).sum(1)).sum()

    docs = []
    for _ in range(400):
        n, k = int(rng.integers(1, 120)), int(rng.integers(1, 4))
        ll = rng.normal(-9, 1.5, (n, 4))
        ll[np.arange(n), rng.choice(4, k, replace=False)[rng.integers(0, k, n)]] += rng.choice([0.0, 2.0, 5.0])
        docs.append(ll.astype(np.float32))
    ptr = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    pi, size = language_id.mixture(np.concatenate(docs), ptr)
    several = 0
    for d, p, s in zip(docs, pi, size.tolist(), strict=True):
        near = np.maximum(d.astype(np.float64) - d.max(1, keepdims=True), -60)
        lik = np.exp(near)
        best, best_pi, k = near.sum(0).max(), np.eye(4)[near.sum(0).argmax()], 1
        order = np.argsort(-fit(lik, np.full(4, 0.25))[0], kind="stable")
        for m in range(2, 5):
            start = np.zeros(4)
            start[order[:m]] = 1 / m
            q, value = fit(lik, start)
            value -= language_id.PENALTY * (m - 1) * np.log(len(d) + 1) / 2
            if value <= best:
                break
            best, best_pi, k = value, q, m
        several += k > 1
        assert k == s and np.abs(best_pi - p).max() < 1e-3
        alone, one = language_id.mixture(d, np.array([0, len(d)]))
        assert one[0] == s and (alone[0] == p).all()
    assert several > 50


def test_languages_do_not_depend_on_partitions(spark, sf):
    docs = table(spark, sf, "documents")
    three = docs.groupBy().agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("lang", "doc_id", F.substring("text", 1, 90).alias("t")))), 30, 120), lambda x: x["t"]), " ").alias("text")).select(F.lit(-1).cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", "text").unionByName(three)
    langs, model = language_id.train(docs)
    got = [sorted(language_id.predict(rows.repartition(n), langs, model).collect()) for n in (1, 200)]
    assert got[0] == got[1] and got[0][0].n_langs > 1


def split_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def all_overlaps(a, b):
    """The best overlap of two word lists, from every stretch of every diagonal: (-equal, words, start in a, start in b)."""
    need, best = min(decontaminate.MIN_EQUAL, len(b)), None
    for d in range(1 - len(b), len(a)):
        same = [i for i in range(max(0, d), min(len(a), len(b) + d)) if a[i] == b[i - d]]
        for x in range(len(same) - need + 1):
            for y in range(x + need - 1, len(same)):
                n = same[y] - same[x] + 1
                if 4 * (y - x + 1) >= 3 * n:
                    here = (x - y - 1, n, same[x], same[x] - d)
                    best = here if best is None else min(best, here)
    return best


def test_overlaps_against_all_alignments(spark, sf, docs):
    bench = {r.item_id: split_words(r.text) for r in table(spark, sf, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): (-r.n_equal, r.n_words, r.doc_start, r.item_start) for r in QUERIES["op3_decontamination"](spark, sf).collect()}
    want = {}
    for i, d in docs.items():
        a = split_words(d.text)
        for k, b in bench.items():
            if len(b) >= decontaminate.MIN_WORDS and (x := all_overlaps(a, b)):
                want[i, k] = x
    assert got == want and got


def test_masks_meet_short_overlaps():
    """All ways to place the differing words of the shortest overlaps, or many of them."""
    rng = np.random.default_rng(0)
    for n, m in ((12, 2), (13, 3), (14, 3), (16, 4), (20, 5), (28, 7), (40, 10)):
        ways = list(itertools.combinations(range(n), m)) if n <= 20 else [rng.choice(n, m, replace=False) for _ in range(3000)]
        same = np.ones((len(ways), n), bool)
        for row, w in zip(same, ways, strict=True):
            row[list(w)] = False
        met = np.zeros(len(ways), bool)
        for span, read, salt in decontaminate.FAMILIES:
            if salt >= 1000:
                for at in range(n - span + 1):
                    met |= same[:, [at + i for i in read]].all(1)
        assert met.mean() > 0.985, (n, m, met.mean())


def test_overlaps_of_edited_copies(spark):
    """Copies of parts of items with a quarter of their words replaced, in filler, against every alignment."""
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate((5, 7, 9, 10, 11, 12, 14, 16, 20, 30, 45))]
    rows = []
    for i in range(300):
        b = items[i % len(items)][1].split()
        lo = int(rng.integers(0, max(1, len(b) - 12)))
        part = b[lo : lo + int(rng.integers(10, 40))]
        for j in rng.choice(len(part), int(rng.integers(0, len(part) // 4 + 1)), replace=False):
            part[j] = f"q{i}x{j}"
        fill = [f"f{i}x{j}" for j in range(30)]
        rows.append((i, " ".join(fill[:15] + part + fill[15:])))
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    got = {(r.doc_id, r.item_id): (-r.n_equal, r.n_words, r.doc_start, r.item_start) for r in got}
    want = {(i, k): x for i, t in rows for k, b in items if (x := all_overlaps(split_words(t), b.split()))}
    assert all(want[k] == x for k, x in got.items()) and len(got) >= 0.98 * len(want) and len(want) > 150


def test_decontamination_tells_rows_apart(spark, tmp_path):
    """Null, repeated and shared ids of documents and of items."""
    item, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    docs = spark.createDataFrame([(None, item, "x"), (None, "clean words", "x"), (5, item, "x"), (5, "clean words", "y"), (6, other, "x"), (6, other, "x"), (7, None, "x")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(None, item), (9, other), (9, "z " + item)], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.n_equal) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == [("5", "9", 20), ("5", "None", 20), ("6", "9", 20), ("6", "9", 20), ("None", "9", 20), ("None", "None", 20)]
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = decontaminate.stage(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text), r.source) for r in left) == [("5", "clean words", "y"), ("7", "None", "x"), ("None", "clean words", "x")]


def test_substituted_words_are_tolerated(spark):
    rng = np.random.default_rng(4)
    item = [f"b{i}" for i in range(40)]
    rows, hit = [], set()
    for i in range(60):
        w = list(item)
        for j in rng.choice(40, i % 7, replace=False):
            w[j] = f"s{i}x{j}"
        rows.append((i, " ".join([f"f{i}x{j}" for j in range(20)] + w)))
        if i % 7 <= 4:
            hit.add(i)
    rows += [(100 + i, " ".join(f"c{i}x{j}" for j in range(80)) + " b1 b2 b3 b4 b5") for i in range(20)]
    got = {r.doc_id for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")).collect()}
    assert hit <= got and all(i < 100 for i in got)


def test_license_places(spark, sf, docs):
    for r in QUERIES["op5_license_scan"](spark, sf).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(docs[r.doc_id].text))
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p := phrase.split())] == p]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def spellings(rx, most=200):
    """Texts that an expression matches: every alternative, with and without each optional part."""

    def of(node):
        texts = [""]
        for op, arg in node:
            name = str(op)
            if name in ("AT", "ASSERT_NOT", "ASSERT"):
                continue
            if name == "LITERAL":
                one = [chr(arg)]
            elif name == "NOT_LITERAL":
                one = [" "]
            elif name == "BRANCH":
                one = [t for x in arg[1] for t in of(x)]
            elif name == "SUBPATTERN":
                one = of(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, _, x = arg
                one = [*([""] if low == 0 else []), *(t * max(1, low) for t in of(x))]
            else:
                assert name == "IN", name
                one = []
                for kind, x in arg:
                    one.append({"LITERAL": lambda x: chr(x), "RANGE": lambda x: chr(x[0]), "NEGATE": lambda x: " ", "CATEGORY": lambda x: "3" if "DIGIT" in str(x) else " " if "SPACE" in str(x) else "w"}[str(kind)](x))
                    if str(kind) == "NEGATE":
                        break
                one = [" "] if " " in one else one[:2]
            texts = [t + x for t in texts for x in one][:most]
        return texts

    return of(re._parser.parse(rx))


def test_every_alternative_of_every_license_rule_is_found():
    """Through the prefilter, too; and no rule that starts with a word finds it in the middle of one."""
    assert len(licenses.RULES) > 350
    for label, pri, conf, keys, rx in licenses.RULES:
        sc = licenses.Scanner([(label, pri, conf, keys, rx)])
        for text in spellings(sc._expand(rx)):
            assert [x[2] for x in sc.detect(f"see {text} end")] == [label], (label, text)
            if re.match(r"\\b[a-z]", rx) and "|" not in rx:
                assert sc.detect(f"see x{text} end") == [], (label, text)
        assert sc.detect("the quick brown fox and the lazy dog") == []


def test_license_rules():
    sc = licenses.Scanner()
    found = lambda t: [x[2] for x in sc.detect(t.lower())]
    assert found("Licensed under the Apache License, Version 2.0.") == ["apache-2"]
    assert found("GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"]
    assert found("This work is licensed under the GNU General Public License, version 3.")[-1] == "gpl-3"
    assert found("SPDX-License-Identifier: MIT") == ["mit"]
    assert found("Creative Commons Attribution-NonCommercial-ShareAlike 4.0") == ["cc-by-nc-sa-4.0"]
    assert found("an MIT-licensed library") == found("it is MIT licensed") == ["mit"]
    assert found("(c) 2020 A. Body") == found("© 2020") == ["copyright-notice"]
    assert found("the Responsible AI License") == found("CreativeML Open RAIL-M license") == ["openrail"]
    assert found("a permit license, an admit") == []


def test_containment_is_that_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        rules = [("r" + str(i), int(rng.integers(1, 4)), 0.5, ("a",), "".join(rng.choice(list("ab"), rng.integers(1, 5)))) for i in range(8)]
        text = "".join(rng.choice(list("ab"), 200))
        sc, out = licenses.Scanner(rules), []
        found = sorted((-p, i, m.start(), m.end(), label) for i, (label, p, _, _, rx) in enumerate(rules) for m in re.finditer(rx, text))
        for p, _, s, e, label in found:
            if not any(a <= s and e <= b for a, b, *_ in out):
                out.append((s, e, label, -p, 0.5))
        assert sc.detect(text) == sorted(out)


def test_long_texts_of_notices_take_linear_time():
    sc = licenses.Scanner()
    start = time.monotonic()
    assert len(sc.detect("copyright 2020 a b c. " * 200_000)) == 200_000
    assert time.monotonic() - start < 20


def test_quality_statistics(spark, sf, docs):
    got = QUERIES["op6_quality_rules"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        w = WORD.findall(text)
        seen, lines = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [x for x in text.split("\n") if WORD.search(x)]
        cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_ratios_written_out(spark, sf, docs, labels):
    """Ratios, the limit and verdicts from counts over all n-grams; Spark's hash is the only thing taken over."""
    rows = [(i, j, w) for i, d in docs.items() for j, w in enumerate(WORD.findall(d.text or ""))]
    words = spark.createDataFrame([(w,) for w in sorted({w for _, _, w in rows})], "w string").select("w", F.xxhash64("w").alias("h"))
    of = {r.w: r.h for r in words.collect()}
    pairs = {(of[a[2]], of[b[2]]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0]}
    twos = spark.createDataFrame(sorted(pairs), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"))
    two = {(r.a, r.b): r.h % quality_rules.BUCKETS for r in twos.collect()}
    grams = {}
    for i, d in docs.items():
        h = [of[w] for w in WORD.findall(d.text or "")]
        grams[i] = [x % quality_rules.BUCKETS for x in h] + [two[x] for x in zip(h, h[1:], strict=False)]
    raw, target = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in labels and labels[i].quality == 1:
            target.update(g)
    n, m, b = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    ratio = [math.log((target[k] + 1) / (m + b)) - math.log((raw[k] + 1) / (n + b)) for k in range(b)]
    cut = 2 * sum(c * ratio[k] for k, c in raw.items()) / n - sum(c * ratio[k] for k, c in target.items()) / m
    for r in QUERIES["op6_quality_rules"](spark, sf).collect():
        want = sum(ratio[k] for k in grams[r.doc_id]) / len(grams[r.doc_id]) if grams[r.doc_id] else 0.0
        assert abs(r.llr - want) < 1e-9 and r.kept == (not r.base_failed and want >= cut)


def test_quality_of_held_out_documents(spark, sf, labels):
    got = {r.doc_id: r for r in QUERIES["op9_quality_classifier"](spark, sf).collect()}
    held = [i for i, l in labels.items() if l.quality is not None and got[i].held_out]
    assert np.mean([got[i].predicted == labels[i].quality for i in held]) >= 0.9
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got.values())


def test_classifier_learns_from_the_documents_that_are_there(spark, monkeypatch):
    """Labels of absent documents, of held-out documents only, of other number types, and repeated ids."""
    good, bad = "The town has a quiet river and an old bridge. ", "xx $$ 11 ## qq !! "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(200)] + [(7, good)] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.range(200_000).selectExpr("id AS doc_id", "CAST(id % 2 AS BIGINT) AS quality")
    split = lambda m: {(r.doc_id % 2, r.predicted) for r in quality_classifier.score(docs, m).collect()}
    assert split(quality_classifier.train(docs, labels)) == {(0, 0), (1, 1)}
    assert split(quality_classifier.train(docs, labels.selectExpr("CAST(doc_id AS STRING) AS doc_id", "CAST(quality AS DOUBLE) AS quality"))) == {(0, 0), (1, 1)}
    absent = quality_classifier.train(docs, labels.filter("doc_id >= 1000"))
    assert quality_classifier.score(docs, absent).filter("score <> 0.5").count() == 0
    monkeypatch.setattr(quality_classifier, "SAMPLE_FEATURES", 4000)
    assert split(quality_classifier.train(docs, labels)) == {(0, 0), (1, 1)}


def test_dual_descent_reaches_the_optimum():
    """No coordinate step improves the dual any more, and the weights are those of its variables."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 8))
    y = np.where(x[:, 0] + 0.3 * rng.normal(0, 1, 60) > 0, 1.0, -1.0)
    w = quality_classifier.dual_descent([np.arange(8)] * 60, list(x), y, np.full(60, 0.7), 8, rounds=3000)
    z = np.hstack((x, np.ones((60, 1))))
    loss = lambda w: w @ w / 2 + 0.7 * np.maximum(0, 1 - y * (z @ w)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-2 for d in 0.05 * rng.normal(0, 1, (300, 9)))


def test_hashes_see_whole_words():
    import pyarrow as pa

    texts = [None, "", "  a b\x0bc  ", "aé b", "ab c" * 500, "A b", "\x1cx"]
    w = W.split(pa.array(texts), True)
    want = [WORD.findall(lower(t)) for t in texts]
    assert w.n.tolist() == [len(x) for x in want]
    h, flat = w.hashes(), [x for t in want for x in t]
    assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(h.tolist())) == len(set(flat))
    x, at = W.windows(h, w.ptr, 2)
    pairs = [tuple(t[i : i + 2]) for t in want for i in range(len(t) - 1)]
    assert len(at) == len(pairs) and len(set(zip(x.tolist(), pairs, strict=True))) == len(set(pairs)) == len(set(x.tolist()))


def _shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _firsts(rows):
    """Ids of one document of each group of linked ones, and of all without words."""
    sets = {i: _shingles(t) for i, t in rows.items()}
    group = {i: i for i in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(sorted(rows), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = top(i), top(j)
            group[max(x, y)] = min(x, y)
    return {i for i in rows if not sets[i] or top(i) == i}


def _without_repeats(rows, k=substring_dedup.K):
    """Words of each document that are left, in the order of ids."""
    words, first, out = {i: WORD.findall(t or "") for i, t in rows.items()}, {}, {}
    for i, w in sorted(words.items()):
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    for i, w in words.items():
        gone = {p + j for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for j in range(k)}
        out[i] = [x for p, x in enumerate(w) if p not in gone]
    return out


def test_pipeline(spark, sf, docs, labels):
    """Each stage on what the one before it left, against brute force."""
    bench = [split_words(r.text) for r in table(spark, sf, "benchmark").collect()]
    state, was = table(spark, sf, "documents"), {i: d.text for i, d in docs.items()}
    for name, stage in corpus_pipeline.STAGES:
        state = materialise(stage(spark, state, sf), "stage")
        got = {r.doc_id: r.text for r in state.select("doc_id", "text").collect()}
        assert state.count() == len(got) and got.keys() <= was.keys(), name
        if name != "mixing":
            assert state.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_classifier":
            scores = {r.doc_id: r.predicted for r in QUERIES["op9_quality_classifier"](spark, sf).collect()}
            assert got.keys() == {i for i in was if scores[i]} and len(got) > 0.8 * len(was)
            assert not any(labels[i].quality == 0 for i in got if i in labels)
        elif name == "jaccard_dedup":
            assert got.keys() == _firsts(was)
        elif name == "substring_dedup":
            left = _without_repeats(was)
            assert {i: WORD.findall(t or "") for i, t in got.items()} == {i: w for i, w in left.items() if w or not WORD.search(was[i] or "")}
            assert all(t == was[i] for i, t in got.items() if left[i] == WORD.findall(was[i] or ""))
        elif name == "decontamination":
            assert got.keys() == {i for i, t in was.items() if not any(len(b) >= decontaminate.MIN_WORDS and all_overlaps(split_words(t), b) for b in bench)}
        if name != "mixing":
            assert all(got[i] == was[i] for i in got) or name == "substring_dedup"
        before, was = was, got
    # The queue written out, over what the stage before left.
    size = {i: len(WORD.findall(t or "")) for i, t in before.items()}
    by = collections.defaultdict(list)
    for i, t in before.items():
        key = int(hashlib.md5(f"{mixing.SEED}|{i}|{t or ''}".encode()).hexdigest()[:15], 16)
        by[docs[i].source].append((key, i, size[i]))
    entries = []
    for rank, src in enumerate(sorted(by, key=lambda x: (x is None, (x or "").encode()))):
        weight, end, whole = mixing.WEIGHTS[rank % 3], 0, sum(n for _, _, n in by[src])
        for key, i, n in sorted(by[src]):
            end += n
            entries += [((end + p * whole) / weight, src is None, src or "", p, key, i, n) for p in range(2) if n]
    total, copies = 0, collections.Counter()
    for e in sorted(entries):
        total += e[-1]
        if total - e[-1] / 2 <= mixing.SHARE * sum(size.values()):
            copies[e[-2]] += 1
    assert {r.doc_id: (r.copies, r.taken) for r in state.collect()} == {i: (c, c * size[i]) for i, c in copies.items()}
    assert corpus_pipeline.run(spark, sf).count() == len(was)


def test_language_model_trains_on_every_document(spark, monkeypatch):
    """Every word of every row, repeated rows and long texts included; and what a row adds shows in the scores."""
    rows = [(i, "red fox runs " * 20) for i in range(40)] + [(1, "red fox runs " * 20)] * 5 + [(100, "blue cat sleeps " * 4000)]
    full, short = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows, rows[:-1]))
    seen = []
    real = lm_scoring.train_all
    monkeypatch.setattr(lm_scoring, "train_all", lambda *a: seen.append(real(*a)) or seen[-1])
    for docs in (full, short):
        lm_scoring.lm_score(docs).collect()
    assert [n for _, n in seen] == [sum(len(t.split()) + 1 for _, t in x) for x in (rows, rows[:-1])]

    test = spark.createDataFrame([(0, "blue cat sleeps " * 20)], "doc_id long, text string")
    with_it = lm_scoring.lm_score(test, full).first().score
    monkeypatch.setattr(lm_scoring, "train_all", lambda rows, v, *a: (lm_scoring.Network(v), 0))
    assert with_it > lm_scoring.lm_score(test, full).first().score


def test_rounds_of_few_rows_fill_their_copies(spark, monkeypatch):
    """A round of few shares trains fewer copies, on more rows each, and still on every row."""
    words = [b"", *(f"w{i}".encode() for i in range(50))]
    v = _vocabulary(words, np.arange(120, 120 - len(words), -1))
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, v.head, 9), v.end).astype(np.uint16) for _ in range(640)]
    encoded = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "symbols binary").repartition(16).localCheckpoint()
    copies, real = [], type(encoded).mapInArrow
    monkeypatch.setattr(type(encoded), "mapInArrow", lambda df, *a: copies.append(df.rdd.getNumPartitions()) or real(df, *a))
    _, n = lm_scoring.train_all(encoded, v, spark.sparkContext.broadcast(v))
    assert copies == [2, 2, 4, 8, 16, 16] and n == 6400


def test_repeated_rows_have_one_score(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{i}" for i in rng.zipf(1.3, n) % 400)
    same = text(300)
    docs = spark.createDataFrame([(i, same if i % 3 else text(50 + 7 * i)) for i in range(120)], "doc_id long, text string").repartition(5)
    got = lm_scoring.lm_score(docs).collect()
    assert len(got) == 120 and len({r.score for r in got if r.doc_id % 3}) == 1 and len({r.score for r in got}) == 41


@pytest.mark.parametrize("scale", [1, 40])
def test_language_model_equals_plain_softmaxes(scale):
    """Shares of classes and of words in them, for small weights and for those whose logits have to be shifted."""
    words = [b"", *(f"w{i}".encode() for i in range(50))]
    v = _vocabulary(words, np.arange(120, 120 - len(words), -1))
    net, rng = lm_scoring.Network(v), np.random.default_rng(3)
    for k in ("wc", "bc", "wo", "bo"):
        net.p[k] += scale * rng.normal(0, 0.5, net.p[k].shape).astype(np.float32)
    s, target = rng.uniform(-1, 1, (3000, lm_scoring.HIDDEN)).astype(np.float32), rng.integers(0, v.symbols, 3000).astype(np.uint16)
    p = {k: x.astype(np.float64) for k, x in net.p.items()}
    share = lambda a: a - a.max() - np.log(np.exp(a - a.max()).sum())
    got, ds = net.output(s, target, v, {})
    assert np.array_equal(got, net.output(s, target, v)[0]) and np.isfinite(ds).all()
    for x, t, g in zip(s[:300].astype(np.float64), target.tolist(), got.tolist(), strict=False):
        k = int(v.class_of[t])
        want = share(x @ p["wc"] + p["bc"])[k]
        if t < v.head:
            lo, hi = v.first[k : k + 2]
            want += share(p["wo"][lo:hi] @ x + p["bo"][lo:hi])[t - lo]
        assert abs(want - g) < 1e-4 * max(1, abs(want))


def test_a_weak_opening_does_not_hide_the_rest_of_a_diagonal(spark):
    item = [f"w{i}" for i in range(80)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    # Only one seed's words of the opening are kept, then nothing up to the word 40.
    opening = [w if c == "1" else f"z{i}" for i, (w, c) in enumerate(zip(item, decontaminate.MASKS[0], strict=False))]
    doc = opening + [f"n{i}" for i in range(40 - len(opening))] + item[40:]
    docs = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in got] == [(1, 7, 40, 40, 40)]


def _near_copies(rng, n):
    """Texts over few words with edits, cuts and exact copies."""
    base = [list(rng.choice([f"w{i}" for i in range(40)], int(rng.integers(1, 60)))) for _ in range(6)]
    out = []
    for i in range(n):
        w = list(base[int(rng.integers(0, len(base)))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 9)}"
        out.append((int(rng.integers(0, n)), " ".join(w[int(rng.integers(0, 3)) :]) or None))
    return out


def test_components_against_all_pairs(spark, monkeypatch):
    """Blocks, slices and ranges far smaller than the groups of copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SLICE", 400)
    rows = _near_copies(np.random.default_rng(12), 240)
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        x = len(sets[i] & sets[j])
        if sets[i] and 100 * x >= 80 * len(sets[i] | sets[j]):
            comp[top(j)] = top(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(d, low.get(top(i), d))
    want = sorted((d, len(s), low[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard_join.shingle_components(docs).collect())) == want
    left = jaccard_join.stage(spark, docs, "").collect()
    keep = {top(i): min((d, t) for j, (d, t) in enumerate(rows) if top(j) == top(i))[0] for i, (d, _) in enumerate(rows) if sets[i]}
    assert sorted(r.doc_id for r in left) == sorted([*keep.values(), *(d for (d, _), s in zip(rows, sets, strict=True) if not s)])


def test_one_row_of_each_component_stays(spark):
    t, u = "one two three four five six seven", "other words of another kind here now"
    rows = [(1, t, "a"), (1, t, "b"), (2, t, "c"), (None, t, "d"), (None, u, "e"), (None, u, "f"), (3, None, "g"), (3, None, "h"), (4, "", "i"), (1, "alone in its own kind of words", "j")]
    left = jaccard_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted([("1", t), ("None", u), ("3", "None"), ("3", "None"), ("4", ""), ("1", "alone in its own kind of words")])


@pytest.mark.parametrize("crowd", [0, 20, 200])
def test_removed_words_against_all_windows(spark, monkeypatch, crowd):
    """Slices of a few texts, so that hot windows come from many; repeated ids and ties."""
    monkeypatch.setattr(substring_dedup, "SLICE", 300)
    monkeypatch.setattr(substring_dedup, "SALTS", 3)
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng, k = np.random.default_rng(5), 6
    hot = [f"h{i}" for i in range(9)]
    line = [f"l{i}" for i in range(7)]
    rows = []
    for _ in range(160):
        w = list(rng.choice([f"v{i}" for i in range(4)], int(rng.integers(0, 30))))
        if rng.random() < 0.6:
            w[len(w) // 2 : len(w) // 2] = hot if rng.random() < 0.7 else line * 4
        rows.append((int(rng.integers(0, 140)), " ".join(w)))
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            first[x] = min(d, first.get(x, d))
    want = []
    for d, t in rows:
        w = t.split()
        gone = {i + j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(k)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, substring_dedup.substring_dedup(docs, k=k, digest=True).collect())) == sorted(want)
