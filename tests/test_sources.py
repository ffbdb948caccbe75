"""Sources that are read in pieces: JSON objects by byte ranges, line numbers over blocks."""

import json
import random

import pytest

from ticketlens.sources import jsonobject, stores, tickets

NASTY = ['plain', 'quote " inside', 'back \\ slash', 'ends with \\', '\\"', '{"not": [1, "a"]}', 'ünï → 漢字 🎉', ']}],', '', '\\\\"\\', '": [{']


def _object(seed, records=60):
    rng = random.Random(seed)
    return {name: [{"text": rng.choice(NASTY) * rng.randint(0, 3), "label": rng.choice(NASTY),
                    "extra": {"deep": [rng.choice(NASTY), {"x": rng.choice(NASTY)}]}} for _ in range(rng.randint(0, records))]
            for name in ["billing", 'odd "key\\', "", "returns", "漢字"]}


@pytest.mark.parametrize("size, indent", [(7, None), (61, 2), (500, None), (1 << 20, 1)])
def test_records_of_an_object_by_ranges(spark, tmp_path, size, indent):
    made = _object(size)
    path = tmp_path / "seed.json"
    path.write_text(json.dumps(made, ensure_ascii=size == 61, indent=indent))
    rows = jsonobject.read_records(spark, str(path), "text string, label string", 2, size=size)
    assert rows.rdd.getNumPartitions() > 1 or size > 10_000
    got = sorted((r["keys"][0], r["record"]["text"], r["record"]["label"]) for r in rows.collect())
    assert got == sorted((k, r["text"], r["label"]) for k, rs in made.items() for r in rs)


def test_escapes_that_cross_ranges(spark, tmp_path):
    path = tmp_path / "seed.json"
    records = [{"text": "\\" * n + '"' * m} for n in range(9) for m in range(3)]
    path.write_text(json.dumps({"a": records}))
    for size in (1, 2, 3, 5, 11):
        rows = jsonobject.read_records(spark, str(path), "text string", 2, size=size)
        assert sorted(r["record"]["text"] for r in rows.collect()) == sorted(r["text"] for r in records)


def test_objects_that_are_odd(spark, tmp_path):
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "scalars.json").write_text('{"a": "text", "b": [1, "x", null], "c": {"d": 1}, "e": [{"text": "in"}]}')
    (tmp_path / "cut.json").write_text('{"a": [{"text": "whole"}, {"text": "cut o')
    rows = jsonobject.read_records(spark, str(tmp_path), "text string", 2, size=9)
    assert sorted((r["keys"][0], r["record"]["text"]) for r in rows.collect()) == [("a", "whole"), ("e", "in")]
    with pytest.raises(FileNotFoundError):
        jsonobject.read_records(spark, str(tmp_path / "absent.json"), "text string", 2)


def test_registry_keeps_its_settings(spark, tmp_path):
    made = {"config": {"primary_metric": "loss", "greater_is_better": False, "top_k": 3},
            "checkpoints": {"billing": [{"step": i, "metrics": {"eval_loss": i / 10}} for i in range(40)], "returns": []}}
    path = str(tmp_path / "registry.json")
    with open(path, "w") as f:
        json.dump(made, f, indent=2)
    rows = stores.load_registry(spark, path, size=100)
    assert sorted(r["step"] for r in rows.collect()) == list(range(40)) and rows.first()["domain"] == "billing"
    assert stores.load_registry_config(spark, path) == made["config"]
    table = str(tmp_path / "registry")
    stores.save_registry(rows, table, made["config"])
    assert stores.load_registry(spark, table).count() == 40
    assert stores.load_registry_config(spark, table) == made["config"]
    stores.save_registry(rows, table)
    assert stores.load_registry_config(spark, table) == {} == stores.load_registry_config(spark, str(tmp_path / "no"))


def test_line_numbers_over_blocks(spark, tmp_path):
    want = set()
    for name in ("a", "b"):
        lines = []
        for i in range(1, 3001):
            bad = (i * 7 + len(name)) % 97 == 0
            lines.append("" if i % 31 == 0 else "{broken %d" % i if bad else '{"ticket_id": %d, "text": "line of some length"}' % i)
            if bad and i % 31:
                want.add((name, i, "{broken %d" % i))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            good, bad = tickets.read_tickets_jsonl(spark, str(tmp_path))
            got = {(r["file"].rsplit("/", 1)[1][0], r["line_no"], r["line"]) for r in bad.collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert good.count() == 6000 - len(want) - 2 * (3000 // 31)
