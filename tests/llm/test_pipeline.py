"""The five stages over small tables: rejected junk goes, and the rest is held against brute force."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from ledgerloom.llm import mixing, quality_classifier

WORDS = [f"word{i}" for i in range(500)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _one_of_each(rows):
    top = {r[0]: r[0] for r in rows}
    sets = {r[0]: _shingles(r[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return [r for r in rows if top[r[0]] == r[0]]


def _contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    d, hit = words(text), set()
    for _, item in items:
        w = words(item)
        n = min(13, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        hit |= {k + o for k in range(len(d) - n + 1) if tuple(d[k : k + n]) in wins for o in range(n)}
    return bool(hit) and 20 * len(hit) >= len(d)


def _tables(spark, folder, rows, items, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    good = [_text(rng, 100) for _ in range(60)]
    junk = [" ".join(rng.choice(["$$$", "!!!", "CLICK", "0000", "###"]) for _ in range(100)) for _ in range(40)]
    near = [" ".join(["other", *t.split()[1:]]) for t in good[:8]]
    items = [(1, _text(rng, 30)), (2, None), (3, "")]
    told = [t + " " + items[0][1] for t in good[20:24]]
    texts = good + near + good[:3] + told + junk
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    bad = set(range(len(texts) - len(junk), len(texts)))
    folder = _tables(spark, tmp_path, rows, items, [(i, int(i not in bad), int(i in bad and i % 2)) for i, *_ in rows])
    kept = [r for r in _one_of_each([r for r in rows if r[0] not in bad]) if not _contaminated(r[1], items)]
    assert 0 < len(kept) < len(good) + len(told)
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len(r[1].encode()) + 1, zlib.crc32(r[1].encode())) for r in kept)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_without_labels_nothing_is_rejected(spark, tmp_path):
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "$$$ 000", "en", "a", 7), (None, "no id", "en", None, 5)]
    folder = _tables(spark, tmp_path, rows, [(1, "nothing of it")], [(2, None, None)])
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == Counter([0, 1, 2, None])


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows = [(i, f"text {i} of some words", "en", "a", 5) for i in range(5)]
    folder = _tables(spark, tmp_path, rows, [(1, "nothing of it")], [(0, 1, 0), (1, 0, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    assert quality_classifier.accepted(docs.limit(0), None).columns == docs.columns


def test_slots_follow_the_mix(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "en", "big" if i % 10 else "small", 5) for i in range(3000)]
    folder = _tables(spark, tmp_path, rows, [], [])
    at = {r["doc_id"]: (r["time_slot"], r["in_block"]) for r in mixing.mix_order(spark.read.parquet(f"{folder}/documents.parquet")).collect()}

    def in_mix_order(stages):
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
        by_shard = {}
        for r in corpus_pipeline.run(spark, folder).collect():
            by_shard.setdefault(r["shard"], []).append((r["slot"], at[r["doc_id"]]))
        assert sum(map(len, by_shard.values())) == len(rows)
        return all([p for _, p in sorted(s)] == sorted(p for _, p in s) for s in by_shard.values())

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        last = corpus_pipeline.STAGES[3:]
        assert in_mix_order(last)
        assert not in_mix_order([("mixed", lambda spark, docs, sf_dir: docs), last[1]])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
