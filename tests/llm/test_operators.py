"""The corpus operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import decontamination, jaccard_join, mixing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, url_filters

# columns named like ones the operators make up
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, rep long, k string, _id long, key long, at long, part long, n long, label string"
WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", "   ", "a", "one two three", "x" * 5000, "é" * 300, _text(rng, 3000), "dup line\n" * 80]
    base = [_text(rng, 120) for _ in range(12)]
    texts += base + base[:3]
    for b in base[:6]:
        words = b.split()
        words[60] = "changed"
        texts.append(" ".join(words))
    texts += ["prefix " + base[7][:260] + " suffix", "write to jo.doe@mail.example.com or +49 30 1234567890, from 10.1.2.3", base[9].upper(), "<|endoftext|> and  two  spaces \n x"]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 2, "k", 3, 4, 5, 6, 7, "x") for i, t in enumerate(texts)]
    return [*out, out[12], out[12], (None, base[0], "en", "s1", 3, 1, 2, "k", 3, 4, 5, 6, 7, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def _found(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_token_counts(docs, rows):
    from ledgerloom.llm.queries import tokenizer_path

    tok = token_counts._tokenizer(tokenizer_path())
    want = Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert _found(token_counts.token_counts(docs, tokenizer_path()), "doc_id", "n_bytes", "n_tokens") == want


def test_token_counts_of_odd_texts():
    from ledgerloom.llm.queries import tokenizer_path

    tok = token_counts._tokenizer(tokenizer_path())
    lengths = token_counts._Lengths(tok, token_counts.frequent_lengths(tokenizer_path()))
    rng = random.Random(0)
    parts = [" ", " ", "\n", "\t", "a", "b", "é", "1", "!", "'s", "<|endoftext|>", " ", "　", "\x1c", "՘", "\x85", "日", " the"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert token_counts.count_tokens(s, lengths) == len(tok.encode(s, add_special_tokens=False).ids), repr(s)


def test_quality_rules(docs, rows):
    want = Counter()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(5)}
        lines = [x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(r[0], len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))] += 1
    ledger = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.V1)
    assert _found(ledger, "doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed") == want
    cut = {r["rule"]: r for r in quality_rules.ablations(ledger, quality_rules.V1).collect()}
    kept = ledger.where("kept").count()
    without = quality_rules.Policy("x", tuple(r for r in quality_rules.RULES if r != "repeated_windows"))
    assert quality_rules.apply_policy(ledger, without, without).where("kept").count() == kept + cut["repeated_windows"]["failed_only"]


def _pattern_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == 1 and any(int(x) > 255 for x in m[0].split("."))) and not (k == 2 and not (14 <= len(d) <= 19 and pii._luhn(d))) and not (k == 3 and not 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(docs, rows):
    want = Counter((r[0], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in _pattern_spans(r[1] or "")).encode()).hexdigest()) for r in rows)
    assert _found(pii.span_digest(docs), "doc_id", "base_sha256") == want
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("ab.@-+_ 01259.@+()é") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == _pattern_spans(t), t


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    told = [(i, f"{_plain(rng)} Zorblax {_plain(rng)} z@secret.example.org {_plain(rng)}") for i in range(6)]
    rest = [(10 + i, _plain(rng, 30)) for i in range(300)]
    docs = spark.createDataFrame(told + rest, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("Zorblax" not in clean[i] and "[EMAIL]" in clean[i] for i, _ in told)
    assert all(clean[i] == t for i, t in rest)


def _plain(rng, n=4):
    return " ".join(rng.choice(["the", "and", "with", "from", "that", "this", "have", "not"]) for _ in range(n))


def test_near_duplicates(docs, rows):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    low = {k: min([j for j in sets if sets[j] == s] if s else [k]) for k, s in sets.items()}
    reps = sorted(set(low.values()))
    links = {(a, b) for a in reps for b in reps if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    top = {k: k for k in reps}
    for _ in reps:
        for a, b in links:
            top[a] = min(top[a], top[b])
    want = {(k, low[k], top[low[k]], sum(a == low[k] for a, _ in links)) for k in sets}
    got = _found(jaccard_join.near_duplicates(docs), "doc_id", "text_class", "class_id", "n_links")
    assert {g for g in got if g[0] is not None} == want and sum(got.values()) == len(rows)
    assert {g[1:] for g in got if g[0] is None} == {w[1:] for w in want if w[0] == rows[9][0]}  # the row without an id repeats that text
    assert any(n for *_, n in want)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({top[low[k]] for k in sets})


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    rng = random.Random(12)
    a, b, c = (_text(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, c), (None, c + " more"), (None, _text(rng, 60)), (3, b + " more"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, None, 1), (None, None, 1), (None, None, 0), (3, 1, 1), (None, None, 0), (4, 4, 0)])
    assert len({r["class_hash"] for r in got if r["n_links"]}) == 3 and sum(r["class_hash"] is None for r in got) == 2
    kept = _found(jaccard_join.one_of_each(docs), "doc_id", "text")
    assert {x for x in kept if x[0] is not None or x[1] is None or x == rows[6]} == {(1, a), (1, b), rows[6], (None, None), (4, "")}
    assert sum(kept.values()) == 6 and len(kept) == 6


def test_a_row_that_repeats_the_surviving_id_and_text_goes(spark):
    text = _text(random.Random(13), 30)
    docs = spark.createDataFrame([(7, text, "x"), (7, text, "y"), (9, text, "z"), (7, text, "x"), (8, "  ", "w"), (8, "  ", "w")], "doc_id long, text string, note string")
    kept = sorted((r["doc_id"], r["note"]) for r in jaccard_join.one_of_each(docs).collect())
    assert kept[1:] == [(8, "w"), (8, "w")] and kept[0] in [(7, "x"), (7, "y")]


def test_large_group_is_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(150)] = f"new{i}"
        texts.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    got = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in texts]
    want = {i: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {r["doc_id"]: r["n_links"] for r in got} == want and {r["class_id"] for r in got} == {0}


def test_url_filters(spark):
    urls = [None, "no scheme", "http://A.Net/x", "https://sub.example.net/en/1?q#f", "http://example.com/de/", "http://x.org/fr/a", "http://good.io/a", "http://bad.io/", "ftp://net"]
    html = {6: '<a href="http://x.org/fr/">', 7: '<a href="http://a.net/">'}
    pages = spark.createDataFrame([(i, u, html.get(i)) for i, u in enumerate(urls)] + [(2, urls[2], None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_verdicts(pages).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.net", "/x", "net/", "block") and got[3] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][3] == "allow" and got[7][3] == "block"  # links to a blocked host
    assert got[8] == ("net", "", None, "block")  # its host is a seed, the empty path is under no rule


def test_sharding(docs, rows):
    import zlib

    got = sharding.shard_rows(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    vslot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % sharding.VIRTUAL_SLOTS
    size = Counter()
    for r in got:
        size[r["vslot"]] += r["size"]
    assert all(r["vslot"] == vslot(r["doc_id"]) and r["vslot_bytes"] == size[r["vslot"]] and r["map_version"] == 1 for r in got)
    draw = lambda v, m: int(hashlib.md5(f"{v}:{m}".encode()).hexdigest()[:8], 16)
    owner = lambda v, n: max((m for m in range(1, n) if draw(v, m) * (m + 1) < 1 << 32), default=0)
    assert all((r["shard"], r["grown_shard"]) == (owner(r["vslot"], 8), owner(r["vslot"], 9)) for r in got)


def test_slot_map_is_edited_from_bytes(spark, docs):
    sizes = spark.range(64).selectExpr("id AS vslot", "id * id AS bytes").where("vslot <> 5")
    maps = sharding.slot_maps(spark, (4,), 64)
    moves = sharding.rebalance(maps, 1, sizes)
    edited = sharding.move_slots(maps, 1, moves)
    shard = {(r["version"], r["vslot"]): r["shard"] for r in edited.collect()}
    assert len(shard) == 128 and {v for v, _ in shard} == {1, 2}
    moved = {r["vslot"]: r["shard"] for r in moves.collect()}
    assert moved and all(shard[2, v] == moved.get(v, shard[1, v]) for v in range(64))
    load = {v: Counter() for v in (1, 2)}
    for (v, slot), s in shard.items():
        load[v][s] += slot * slot if slot != 5 else 0
    mean = sum(load[1].values()) / 4
    assert max(abs(x - mean) for x in load[2].values()) <= min(63 * 63, max(abs(x - mean) for x in load[1].values()))
    held = {r["vslot"]: (r["rows"], r["bytes"]) for r in sharding.slot_bytes(docs).collect()}
    rows = sharding.shard_rows(docs).collect()
    assert held == {r["vslot"]: (sum(x["vslot"] == r["vslot"] for x in rows), r["vslot_bytes"]) for r in rows}


def test_an_id_with_many_rows_is_numbered_in_parts(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id * 4294967296 END AS doc_id", "concat('t', id % 700) AS text", "'s' AS source")
    got = sharding.shard_rows(docs).collect()
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    order = mixing.mix_order(docs, block_rows=2).collect()
    assert len({(r["time_slot"], r["in_block"]) for r in order}) == len(order) == 3000
    assert docs.select(mixing.scatter(docs["doc_id"])).distinct().count() > 1490


def test_mixing_stays_within_a_block(spark):
    many = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'big' WHEN id % 10 = 1 THEN NULL ELSE concat('s', id % 7) END AS source")
    got = mixing.mix_order(many, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6000))
    units, blocks = {r["source"]: r["units"] for r in got}, {}
    for r in got:
        blocks[r["time_slot"]] = r["source"]
    assert sum(units.values()) == mixing.PERIOD
    last = min(max(t for t, s in blocks.items() if s == src) for src in units)
    had = Counter()
    for t in range(last + 1):
        had[blocks[t]] += 1
        assert all(abs(had[s] - (t + 1) * u / mixing.PERIOD) < 1 for s, u in units.items())


def test_mixed_keeps_rows(docs, rows):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows)


def test_decontamination(spark, docs, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = {r[0]: r[1] for r in rows}
    items = [(1, " ".join(texts[9].split()[10:40])), (2, "one two three"), (3, None), (4, ""), (5, " ".join(texts[10].split()[:13])), (6, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in rows:
        d, hit, found = words(r[1]), set(), []
        for i, t in items:
            w = words(t)
            n = min(13, len(w))
            wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            at = [k for k in range(len(d) - n + 1) if tuple(d[k : k + n]) in wins]
            hit |= {k + o for k in at for o in range(n)}
            found += [str(i)] * bool(at)
        want[(r[0], len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(d))] += 1
    got = decontamination.contamination(docs, bench)
    assert _found(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    bad = {w[0] for w in want if w[-1]}
    assert {r["doc_id"] for r in decontamination.uncontaminated(docs, bench).collect()} == {r[0] for r in rows} - bad


def test_proximity_matches(spark):
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 400])))) for i in range(12)] + [(None, "a b a"), (3, "b a")]
    docs = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string")
    idx = decontamination.index(docs, spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))
    got = decontamination.near_phrases(idx, spark.createDataFrame([("a", "b"), ("a", "c")], "t1 string, t2 string"), 4)
    want = Counter()
    for i, t in set(texts):
        w = t.split()
        want.update((x, y, i, p, q) for x, y in (("a", "b"), ("a", "c")) for p in range(len(w)) for q in range(max(0, p - 4), min(len(w), p + 5)) if w[p] == x and w[q] == y)
    assert _found(got, "t1", "t2", "doc_id", "p1", "p2") == want


def test_repeats(docs, rows):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[p : p + 200] for _, b in data for p in range(len(b) - 199))
    want = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
    assert _found(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_classifier.fit(docs, labels.where("doc_id % 5 <> 0"))
    assert model.thresholds[0] < model.thresholds[1]
    held = quality_classifier.graded(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id")
    share = {(r["quality"], r["toxic"]): r["k"] for r in held.groupBy("quality", "toxic").agg({"kept": "count"}).withColumnRenamed("count(kept)", "k").collect()}
    kept = Counter((r["quality"], r["toxic"]) for r in held.where("kept").collect())
    assert kept[(1, 0)] >= 0.97 * share[(1, 0)]
    assert kept[(0, 0)] <= 0.35 * share[(0, 0)] and kept[(1, 1)] <= 0.35 * share[(1, 1)]


def test_classifier_without_labels(spark, docs, rows):
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(docs, none) is None
    kept = quality_classifier.accepted(docs, None)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_empty_tables(spark, docs):
    from ledgerloom.llm.queries import tokenizer_path

    empty = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        token_counts.token_counts(empty, tokenizer_path()), quality_rules.ledger(empty), pii.span_digest(empty), jaccard_join.near_duplicates(empty), sharding.shard_rows(empty),
        mixing.mix_order(empty), decontamination.contamination(empty, bench), suffix_dedup.remove_repeats(empty), url_filters.url_verdicts(pages),
    ):
        assert df.count() == 0
    assert decontamination.contamination(docs, bench).where("contaminated or n_items > 0").count() == 0


def test_clean_rows_of_a_contaminated_id_stay(spark):
    rng = random.Random(8)
    item, clean = _text(rng, 40), [_text(rng, 60) for _ in range(3)]
    docs = spark.createDataFrame([(None, item), (None, clean[0]), (None, None), (1, item), (1, clean[1]), (2, clean[2])], "doc_id long, text string")
    kept = decontamination.uncontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert _found(kept, "doc_id", "text") == Counter([(None, clean[0]), (None, None), (1, clean[1]), (2, clean[2])])


def test_mixing_more_sources_than_a_period(spark):
    many = spark.range(1500 + 4096).selectExpr("id AS doc_id", "CASE WHEN id < 1500 THEN concat('s', id) ELSE 'big' END AS source")
    got = mixing.mix_order(many, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500 + 4096))
    units = {r["source"]: r["units"] for r in got}
    period = sum(units.values())
    assert len(units) == 1501 and abs(units["big"] / period - 64 / (1500 + 64)) < 1 / period + 1e-9  # square roots of 4096 and 1
    blocks = {}
    for r in got:
        assert blocks.setdefault(r["time_slot"], r["source"]) == r["source"]
    had = Counter()
    for t in range(max(blocks) + 1):
        had[blocks.get(t)] += 1
        if t < period:
            assert abs(had["big"] - (t + 1) * units["big"] / period) < 1


def test_schedule_keeps_every_source_to_its_target(spark):
    rng = random.Random(4)
    units = {f"s{i}": rng.choice([1, 1, 2, 3, 50]) for i in range(1200)}
    period = sum(units.values())
    got = mixing.schedule(spark.createDataFrame(list(units.items()), "source string, units long"), period).collect()
    assert sorted(r["at"] for r in got) == list(range(period))
    for r in got:  # block j between its release and its deadline
        u = units[r["source"]]
        assert r["j"] * period // u <= r["at"] < -(-(r["j"] + 1) * period // u)


def test_texts_longer_than_a_block(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(0, 24, 2):
        w = [f"g{i}x{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w[:-1], "other"]))]
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(i, i - i % 2, 1) for i in range(24)}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    forms = ['<a href="http://{}/">', "<a href='//{}/x'>", "<a href=http://{}/a>", "<a HREF = //{}>"]
    hosts = ["a.net", *(f"c{i}.io" for i in range(12))]
    rows = [(0, "http://a.net/", None)] + [(i, f"http://{hosts[i]}/", forms[i % 4].format(hosts[i - 1])) for i in range(1, 13)]
    rows += [(100 + i, f"http://lone{i}.io/", '<a href="/go?to=http://a.net/">') for i in range(60)]
    got = {r["page_id"]: r for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    total = sum(0.85**i for i in range(13))
    assert all(got[i]["distrust"] == pytest.approx(0.85**i / total, rel=1e-4) and got[i]["verdict"] == "block" for i in range(13))
    assert all(got[100 + i]["distrust"] == 0 and got[100 + i]["verdict"] == "allow" for i in range(60))


def test_sanitise_keeps_clashing_columns(docs):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and _found(out.drop("text"), "doc_id", "_id", "th", "key") == _found(docs, "doc_id", "_id", "th", "key")


def test_terms_far_from_their_entity(spark):
    rng = random.Random(6)
    told = [(i, f"Zorblax {_plain(rng, 40)} z@secret.example.org {_plain(rng, 40)} Zorblax") for i in range(6)]
    rest = [(10 + i, _plain(rng, 30)) for i in range(300)]
    docs = spark.createDataFrame(told + rest, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("Zorblax" not in clean[i] and "[EMAIL]" in clean[i] for i, _ in told)
    assert all(clean[i] == t for i, t in rest)
