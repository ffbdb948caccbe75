"""Every operator and stage on nulls, odd texts, ties, repeated rows, clashing names, no rows."""

import hashlib
from collections import Counter

import corpus_pipeline
from ticketlens.llm import (
    jaccard, langid, mixing, packing, pii, pivots, preferences, quality_rules, suffixes, toxicity,
)

N = 11


def test_quality(odd, empty, labels):
    model = quality_rules.fit(odd, labels)
    rows = {r["doc_id"]: r for r in quality_rules.judge(odd, model).collect()}
    assert rows[3]["base_failed"] and rows[5]["n_words"] == 0 and rows[9]["n_words"] == 30_000
    assert rows[9]["n_repeat_words"] == 30_000 and not rows[9]["kept"]
    assert quality_rules.judge(odd, None).count() == N
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).count() == 0
    assert quality_rules.base_counts("a b\nc\n \na b\n#") == (6, 6, 1, 1, 0)
    assert quality_rules.base_counts("a b c d e f a b c d e")[4] == 10


def test_shingle_join(odd, empty):
    rows = jaccard.link(odd).collect()
    got = {(r["doc_id"], r["n_shingles"]): r for r in rows}
    assert len(rows) == N
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert got[(3, 0)]["component_id"] == 3 and got[(5, 0)]["component_size"] == 1
    assert got[(9, 1)]["component_id"] == 9
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == [
        "1", "11", "3", "4", "5", "6", "7", "9", "None"]
    assert jaccard.link(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_link_counts(odd, empty):
    counts = sorted((r["doc_id"] or 0, r["n_links"]) for r in jaccard.link_counts(odd).collect())
    assert counts == [(0, 0), (1, 2), (2, 2), (2, 2), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (9, 0), (11, 0)]
    assert jaccard.link_counts(empty).count() == 0


def test_suffixes(odd, empty):
    rows = suffixes.dedup(odd).collect()
    assert len(rows) == N
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["n_removed"] == by[2][0]["n_bytes"] and len(by[2]) == 2
    assert by[3][0]["n_bytes"] == 0 and by[3][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[9][0]["n_removed"] == 150_000 - 5  # all but the first period
    assert suffixes.dedup(empty).count() == 0


def test_toxicity(odd, empty, labels):
    for rows, n in ((odd, N), (empty, 0)):
        out = toxicity.score(rows, toxicity.fit(rows, labels)).collect()
        assert len(out) == n and all(0 <= r["score"] <= 1 for r in out)


def test_mixing(odd, empty):
    out = mixing.mix(odd).collect()
    assert len(out) == N and all(r["taken"] <= 2 * r["size"] for r in out)
    target, taken = {}, Counter()
    for r in out:
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    assert all(abs(target[s] - taken[s]) <= 1 for s in target) and None in target and "" in target
    again = mixing.scheduled(odd)
    assert again.columns == odd.columns
    words = sum(len(r["text"].encode().split()) for r in again.collect())
    assert words == sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.scheduled(empty).count() == 0
    plan = mixing.targets_of([("b", 10), (None, 4), ("a", 1000)])
    assert [p[0] for p in plan] == ["a", "b", None] and plan[1][2] == 20 and plan[2][2] == 8


def test_pivots(spark):
    v = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (3, None), (4, [None, 1.0]),
         (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (100, [3.0])]
    rows = pivots.scaled(spark.createDataFrame(
        [(a, b, 1) for a, b in v], "vec_id bigint, embedding array<double>, rank int"))
    out = pivots.search(rows).collect()
    first = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == 0)
    assert first == [(1, 50), (2, 50)]
    assert [(r["vec_id"], r["score"]) for r in out if r["query_id"] == 100] == [(7, 3 * 256 * 256)]
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert pivots.search(pivots.scaled(none)).count() == 0
    wide = pivots.scaled(spark.createDataFrame([(0, [2.0 ** 20]), (1, [2.0 ** 21])], "vec_id bigint, embedding array<double>"))
    assert pivots.search(wide).first()["score"] == 2 ** 57


def test_preferences(spark):
    turns = spark.createDataFrame(
        [(0, 0, "user", "hi", 1), (0, 1, "assistant", "a", 1), (1, 0, "user", "hi", 1), (1, 1, "assistant", "b", 1),
         (2, 0, None, None, 1), (3, 0, None, None, 1), (4, None, "user", "x", 1), (None, 0, "user", "y", 1)],
        "conv_id bigint, turn bigint, role string, text string, part int")
    out = preferences.preference_segments(preferences.paired(turns)).collect()
    parts = sorted((r["pair_id"], r["part"], r["turn"]) for r in out if r["turn"] is not None)
    assert parts == [(0, "chosen", 1), (0, "prompt", 0), (0, "rejected", 1), (1, "prompt", 0)]
    for r in out:
        if r["loss_to"]:
            assert r["segment"][r["loss_from"]:r["loss_to"]].endswith("<|end|>\n")
    assert [r["part"] for r in out if r["pair_id"] == 2] == ["chosen"]


def test_pii(odd, empty):
    out = pii.detect(odd)
    assert len(out.columns) == len(odd.columns) + 7 and "_spans" in out.columns
    assert out.count() == N and pii.detect(empty).count() == 0
    assert pii.scrub(odd).columns == odd.columns and pii.scrub(empty).count() == 0


def test_packing(odd, empty):
    out = packing.pack(odd).collect()
    assert sum(r["doc_tokens"] for r in out if r["start"] == 0 and r["doc_id"] in (3, 4)) == 2
    assert packing.pack(empty).count() == 0


def test_language(odd, empty):
    rows = langid.identify(odd, langid.fit(odd))
    got = {r["doc_id"]: r["lang_pred"] for r in rows.collect()}
    assert got[3] == got[4] == got[7] == "und" and "_score" in rows.columns
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_stages(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns, name
            stage(spark, docs, "").count()
