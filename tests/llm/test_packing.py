import random

import pytest

from turnloom.llm import packing
from turnloom.llm.packing import Plan, container_report, pack, token_counts


def checked(rows, sizes, capacity, tiers):
    ends: dict[int, int] = {}
    for r in sorted((r for r in rows if r.size), key=lambda r: (r.container_id, r.offset)):
        assert r.offset >= ends.get(r.container_id, 0) and r.offset + r.size <= capacity
        assert r.width in tiers and r.offset % r.width + r.size <= r.width
        ends[r.container_id] = r.offset + r.size
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(sizes)
    for k, got in by.items():
        got.sort(key=lambda r: r.piece)
        assert sum(r.size for r in got) == (sizes[k] or 0) and len(got) == max(1, -(-(sizes[k] or 0) // capacity))
        assert [r.start for r in got] == [i * capacity for i in range(len(got))]
    return ends


@pytest.mark.parametrize("bucket_rows", [1_000_000, 7])
def test_every_document_has_its_place(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket_rows)
    rng, tiers = random.Random(4), (8, 16, 32)
    sizes = {k: rng.choice([0, 1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 25, 31, 32, 33, 70]) for k in range(600)} | {1000: None, 1001: 0}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()], "doc_id bigint, size bigint, piece string").repartition(5)
    rows = pack(df, tiers=tiers, step=4).collect()
    ends = checked(rows, sizes, 32, tiers)
    used = sum(n or 0 for n in sizes.values())
    assert max(ends) + 1 <= 1.06 * used / 32 + 1
    steps: dict[int, set] = {}
    for r in rows:
        steps.setdefault(r.step, set()).add(r.container_id)
    assert max(map(len, steps.values())) <= 4 and min(map(len, steps.values())) >= 3


def test_one_size_only_and_empty_table(spark):
    df = spark.range(1000).selectExpr("id doc_id", "8192L size")
    rows = pack(df).collect()
    assert len({r.container_id for r in rows}) == 1000 and all(r.offset == 0 for r in rows)
    assert pack(df.limit(0)).count() == 0
    zero = pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, size bigint")).collect()
    assert [(r.size, r.offset) for r in zero] == [(0, 0), (0, 0)]


def test_bad_tiers():
    for tiers in ((16, 8), (8, 12), (3, 8)):
        with pytest.raises(ValueError):
            Plan({1: 1}, tiers)
    with pytest.raises(ValueError):
        Plan({9: 1}, (4, 8))


def test_counts_and_fill_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sized = token_counts(docs)
    sizes = {r.doc_id: r["size"] for r in sized.collect()}
    packed = pack(sized)
    checked(packed.collect(), sizes, 8192, packing.TIERS)
    report = container_report(packed).collect()
    assert sum(r.used for r in report) == sum(sizes.values()) and all(r.used + r.unused == 8192 for r in report)
    assert sum(r.unused for r in report) < 0.02 * 8192 * len(report) + 8192
