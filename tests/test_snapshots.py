"""Snapshots as JSON arrays that no task holds: items against the standard parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwell.sources import snapshots


def value(r, depth=0):
    kind = r.randint(0, 7 if depth < 3 else 3)
    if kind < 3:
        return "".join(r.choice('{}[]",:\\ab é한\n') for _ in range(r.randint(0, 12)))
    if kind == 3:
        return r.choice([1, -2.5, True, None, 0])
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {f'k{i}"}}': value(r, depth + 1) for i in range(r.randint(0, 3))}


def loaded(x):
    try:
        return json.loads(x)
    except (TypeError, ValueError):
        return x


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_items_of_an_array_in_many_blocks(spark, tmp_path, small_blocks):
    r = random.Random(4)
    items = [value(r) for _ in range(60)] + [{"docId": str(i), "text": 'a "}" \\ {[' * r.randint(0, 9)} for i in range(40)] + [{"one": 'x"'}, {"two": '}"\\'}, {"three": "\\\\"}, "s", 3, [], {}]
    for name, text in (("bom", "﻿ " + json.dumps(items, ensure_ascii=False)), ("wide", json.dumps(items, indent=3)), ("scalars", '[1, "}", [2]]\n'), ("one", '[{"a": {}}]'), ("empty", " [ ]\n")):
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        want = json.loads(text.removeprefix("﻿"))
        got = [x.item for x in snapshots.array_items(spark, str(tmp_path / f"{name}.json")).orderBy("ord").collect()]
        assert len(got) == len(want), name
        for g, w in zip(got, want, strict=True):
            assert loaded(g) == w or g == w or (w is None and g is None) or str(w).lower() == str(g).lower(), (name, g, w)
    assert snapshots.array_items(spark, str(tmp_path / "one.json")).select("ord").first().ord == 0
    for name, text in (("object", '{"a": 1}'), ("cut", '[{"a": 1}, {"b"'), ("open", '[{"a": 1}'), ("bad", '[{"a": 1} {"b": 2}]')):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception):
            snapshots.array_items(spark, str(tmp_path / f"{name}.json")).collect()


def test_snapshot_of_several_files(spark, tmp_path, small_blocks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") * 3).alias("ord"), F.col("doc_id").cast("string").alias("docId"), F.array("lang", "source").alias("hierarchy"), "text")
    path = str(tmp_path / "s.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert snapshots.write_snapshot(docs, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(p.name for p in (tmp_path / "s.json").glob("part-*"))
    assert len(files) > 1
    whole = json.loads("".join((tmp_path / "s.json" / f).read_text(encoding="utf-8") for f in files))
    assert [(d["docId"], d["text"]) for d in whole] == [(r.docId, r.text) for r in docs.orderBy("ord").collect()]
    back = snapshots.read_snapshot(spark, path).orderBy("ord").select("ord", "docId", "text").collect()
    assert [tuple(r) for r in back] == [(i, d["docId"], d["text"]) for i, d in enumerate(whole)]
