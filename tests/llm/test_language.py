"""Spelling variants, toxicity and fill-in-middle against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_in_middle, queries, spelling, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, root string, y int, score double, form string, output string, _id long"
CLASH = ("en", "s", 1, "w", 2, "r", 1, 0.5, "f", "o", 3)


def table(spark, pairs):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in pairs], SCHEMA).repartition(3)


def odd_texts(rng):
    letters = "abÀÿ×Zé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)]
    texts = [None, "", "  ", "short", "x" * 3000, "日本語 テキスト", "a" * 7 + "1" + "a" * 7]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)]


def brute_words(pairs, every=31):
    counts = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(counts, ratio=10):
    best, near = {}, {w: [v for v in counts if one_apart(w, v)] for w in counts}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-counts[v], v), default=None)
        best[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out.add((w, n, len(near[w]), best[w], counts.get(best[w]), root))
    return out


def found_groups(df):
    rows = df.collect()
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("shard, sent", [(1 << 20, 32 << 20), (300, 2000), (1, 1)])
def test_spelling_variants(spark, monkeypatch, shard, sent):
    monkeypatch.setattr(spelling, "ROUND_BYTES", sent)
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    rng = random.Random(3)
    texts = odd_texts(rng)[: 20 if shard == 1 else None]
    pairs = [*enumerate(texts), (7, texts[8]), (None, texts[9]), (None, texts[10])]
    pairs += [(100 + k, "Letters " * 300 + "lettrs letteers letterss lettersss lettersss lettersss" * 3) for k in range(2)]
    shards, run = spelling.SHARD_LETTERS, table(spark, pairs)
    assert shards == 1 << 20
    monkeypatch.setattr(spelling, "SHARD_LETTERS", shard)
    want = brute_words(pairs)
    counted = spelling.word_counts(run, typo_every=31)
    assert {(r.word, r.n) for r in counted.collect()} == set(want.items())
    assert found_groups(spelling.variant_groups(counted)) == brute_groups(want)


def test_chains_of_forms_are_followed_to_the_end(spark):
    counts = {"a" * k: 10 ** (k - 7) for k in range(7, 20)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r.root for r in spelling.variant_groups(words).collect()} == {"a" * 19}
    assert found_groups(spelling.variant_groups(words)) == brute_groups(counts)


def test_no_words(spark):
    assert spelling.variant_groups(spelling.word_counts(table(spark, [(1, "only short ones"), (2, None)]))).collect() == []
    assert spelling.variant_groups(spelling.word_counts(table(spark, []))).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(spelling.word_counts(table(spark, [])), ratio=1)


def test_automaton_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        words = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randint(1, 6))) for _ in range(40)})
        trie = spelling.Trie(**spelling.Trie.packed(words, list(range(len(words)))))
        for w in (*words[:10], b"abab", b"a", b"bbbbbbbb"):
            got = spelling.near_words(trie, w)
            assert sorted(got) == [(v, k) for k, v in enumerate(words) if one_apart(w, v)]
            assert sorted(spelling.near_words(trie, w, 1)) == [x for x in sorted(got) if x[0].startswith(w[:1])]
            turned = sorted((x[::-1], k) for k, x in enumerate(words))
            back = spelling.Trie(**spelling.Trie.packed([x for x, _ in turned], [k for _, k in turned]))
            assert sorted(spelling._found([(False, trie), (True, back)], w)) == sorted(got)


def brute_fim(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text
    if h4 % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_pairs():
    rng = random.Random(8)
    texts = [None, "", " ", " \n\t", "a", " a", "a ", "é", "日本 語\x0b", "has <P> inside", "<S>", "ends in <", "<P", "nul \x00 x", " em space ", "x" * 5000]
    texts += ["".join(rng.choice(["wörd", "a", " ", "  ", "\n", "<", "S>", "<<", "\r\n", "𝒳"]) for _ in range(rng.randint(1, 3000))) for _ in range(150)]
    return [*((i * 7, t) for i, t in enumerate(texts)), (7 * 20, texts[20]), (7 * 20, texts[20]), (None, texts[21]), (None, None)]


def test_fill_in_middle(spark):
    pairs = fim_pairs()
    rows = fill_in_middle.fill_in_middle(table(spark, pairs)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == Counter(brute_fim(*p) for p in pairs)
    assert Counter((r.doc_id, r.back) for r in rows) == Counter((i, t or "") for i, t in pairs)
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(table(spark, [])).collect() == []


def test_fill_in_middle_of_ids_as_text(spark):
    docs = spark.createDataFrame([("x1", "some words here"), ("x2", "other words there")], "doc_id string, text string")
    assert {(r.doc_id, r.output) for r in fill_in_middle.fill_in_middle(docs, rate=100).collect()}


@pytest.mark.parametrize("every, piece", [(1, 1), (3, 7), (4, 64), (256, 1 << 20)])
def test_checkpoints(every, piece):
    for _, text in fim_pairs()[:40]:
        data = (text or "").encode()
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or "")
        index = fill_in_middle.Checkpoints(data, every, piece)
        assert index.n == len(units)
        assert len(index.units) == len(index.bytes) == len(index.chars)
        for u in {0, 1, len(units) // 2, len(units), *range(min(12, len(units)))} if len(units) else {0}:
            head = "".join(units[:u])
            assert index.cut(u) == (len(head.encode()), len(head))


BAD = ["vile", "rotten", "beastly"]


def toxic_corpus(n=600, seed=1, noise=0.03):
    """(id, text, toxic, the number of the bad sentence or None)."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    out = []
    for i in range(n):
        said = [[rng.choice(words) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 12 if i % 9 else 300))]
        bad = rng.randrange(len(said)) if i % 4 == 0 else None
        if bad is not None:
            said[bad].insert(1, rng.choice(BAD))
        toxic = int(bad is not None or rng.random() < noise)
        out.append((i, " ".join(" ".join(s).capitalize() + "." for s in said), toxic, bad))
    return out


def test_sentences():
    assert list(toxicity.sentences('One two. "Three!" four\n\n five ... six')) == [["One", "two."], ['"Three!"'], ["four"], ["five", "..."], ["six"]]
    assert list(toxicity.sentences("")) == list(toxicity.sentences(" \n ")) == []
    assert [len(s) for s in toxicity.sentences("w " * 150)] == [64, 64, 22]


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(0)
    bags = [[[0, 2], [1], []], [[3]], [], [[0], [1, 3], [2]], [[2, 3]]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1, 0, 1], pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["y", "bag"])
    x = rng.normal(size=6)

    def value(x):
        (out,) = toxicity._gradient(x)(iter([batch]))
        return out.column(0)[0].as_py(), np.frombuffer(out.column(1)[0].as_py(), np.float32)

    grad = value(x)[1]
    for k in range(6):
        d = np.zeros(6)
        d[k] = 1e-2
        assert abs((value(x + d)[0] - value(x - d)[0]) / 2e-2 - grad[k]) < 2e-3
    # and the loss itself, from the definition
    w, bias, leak = x[:4], x[4], 1 / (1 + np.exp(-x[5]))
    q = [1 - (1 - leak) * np.prod([1 - 1 / (1 + np.exp(-(bias + w[s].sum()))) for s in map(list, b)]) for b in bags]
    assert abs(value(x)[0] + sum(np.log(p if y else 1 - p) for p, y in zip(q, [1, 0, 1, 0, 1]))) < 1e-3


@pytest.fixture(scope="module")
def learned(spark):
    corpus = toxic_corpus()
    docs = table(spark, [(i, t) for i, t, _, _ in corpus])
    labels = spark.createDataFrame([(i, 0, y, "clash") for i, _, y, _ in corpus] + [(None, 1, 1, "c"), (3, 1, None, "c"), (9999, 1, 1, "c")], "doc_id long, quality int, toxic int, text string")
    return corpus, docs, toxicity.fit(docs, labels)


def test_toxicity_on_held_out_rows(spark, learned):
    corpus, docs, model = learned
    rows = {r.doc_id: r for r in toxicity.scored(docs, model).withColumn("held_out", toxicity.held_out()).collect()}
    assert {i for i, r in rows.items() if r.held_out} == {i for i, *_ in corpus if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [(rows[i], bad) for i, _, _, bad in corpus if rows[i].held_out]
    assert len(held) > 80
    assert sum((r.score >= 0.5) == (bad is not None) for r, bad in held) >= 0.98 * len(held)
    # documents were labelled, sentences are found
    where = [(r.worst, bad) for r, bad in held if bad is not None]
    assert sum(a == b for a, b in where) >= 0.95 * len(where)
    hits = {(r.doc_id, r.sentence): r for r in toxicity.offending_sentences(docs, model).collect()}
    assert sum((i, bad) in hits for i, _, _, bad in corpus if bad is not None) >= 140
    assert len(hits) <= 160 and all(r.p >= 0.5 for r in hits.values())
    assert sum(any(b in r.words.lower() for b in BAD) for r in hits.values()) >= 0.97 * len(hits)
    assert sum(r.n_offending for r in rows.values()) == len(hits)


def test_scores_from_the_definition(learned):
    corpus, docs, model = learned
    for r in toxicity.scored(docs.where("doc_id < 60"), model).collect():
        none = 1 - model.leak
        for s in toxicity.sentences(corpus[r.doc_id][1]):
            z = model.bias + sum(float(model.weights[k]) for k in toxicity.features(s))
            none *= 1 - 1 / (1 + np.exp(-z))
        assert abs(r.score - (1 - none)) < 1e-9 and 0 <= r.score <= 1


def test_held_out_labels_are_not_read(spark, learned):
    corpus, docs, model = learned
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.createDataFrame([(i, 0, 1 - y if out(i) else y) for i, _, y, _ in corpus], "doc_id long, quality int, toxic int")
    again = toxicity.fit(docs, labels)
    assert np.allclose(again.weights, model.weights, atol=1e-4) and abs(again.bias - model.bias) < 1e-3


def test_toxicity_edges(spark, learned):
    model = learned[2]
    docs = table(spark, [(None, None), (1, ""), (1, ""), (2, " \n"), (3, "?? !!"), (4, "vile " * 50_000)])
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == 6 and sum(r.score == pytest.approx(model.leak) for r in rows) == 4
    assert [(r.n_sentences, r.worst) for r in rows if r.doc_id == 1] == [(0, None)] * 2
    assert toxicity.scored(table(spark, []), model).collect() == []
    assert toxicity.offending_sentences(table(spark, []), model).collect() == []
    none = "doc_id long, quality int, toxic int"
    for labels, score in (([], 0.0), ([(2, 1, 0)], 0.0), ([(2, 1, 1)], 1.0)):
        flat = toxicity.fit(docs, spark.createDataFrame(labels, none))
        assert {round(r.score, 9) for r in toxicity.scored(docs, flat).collect()} == {score}


def test_queries_have_the_columns_agreed_on(spark):
    sf = "/root/testdata/sf0.001"
    assert set(queries.op11_spelling_variants(spark, sf).columns) >= {"word", "form", "root", "n", "n_near", "form_n"}
    types = dict(queries.op12_toxicity(spark, sf).dtypes)
    assert {k: types[k] for k in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    types = dict(queries.op13_fill_in_middle(spark, sf).dtypes)
    assert types == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
