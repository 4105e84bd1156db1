import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import negatives as G

SCHEMA = "vec_id long, embedding array<double>, label int"


MOST = 2**63 - 1


def brute(rows, every=10, positives=5, negatives=5):
    """Results for the rows whose identifier is divisible by ``every``."""
    own = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(own):
        if i % every:
            continue
        scored = [(-max(-MOST, min(MOST, sum(x * y for x, y in zip(v, w, strict=False)))), j, d) for b, (j, w, d) in enumerate(own) if b != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == c)[:positives]:
            fit = sorted(s[:2] for s in scored if s[2] != c and 80 * -p <= 100 * -s[0] <= 100 * -p)[:negatives]
            out += [(i, pid, r, n, -p, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, every=10, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in G.hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


def vectors(seed, n=300, width=6, labels=3):
    rng = np.random.default_rng(seed)
    # Few values, so that scores are often equal.
    return [(int(i), [float(x) for x in rng.integers(-2, 4, width) / 4], int(rng.integers(labels))) for i in rng.permutation(n)]


@pytest.mark.parametrize("block,tile", [(G.BLOCK_BYTES, G.TILE), (900, (3, 16)), (150, (1, 1))])
def test_results_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(G, "BLOCK_BYTES", block)
    monkeypatch.setattr(G, "TILE", tile)
    rows, every = vectors(1), 10 if block > 150 else 100
    got = found(spark, rows, every)
    assert got == brute(rows, every) and len(got) > 20


def test_numbers_of_places(spark):
    rows = vectors(2, 120)
    assert found(spark, rows, positives=2, negatives=7) == brute(rows, 10, 2, 7)


def test_very_common_vectors(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(400)] + [(1000 + i, [0.4, 0.25], i % 3) for i in range(30)]
    assert found(spark, rows, 100) == brute(rows, 100)


def test_sums_beyond_float64_are_exact(spark):
    big = float(2**40)
    rows = [(0, [big, 1.0, -1.0], 0), (1, [big, 1.0, 0.0], 0), (2, [big, 0.5, 0.0], 1), (3, [big, 0.5, 1.0], 1), (4, [big, 0.25, 0.0], 0), (5, [0.0, 1.0, 0.0], 1)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 2
    a = np.array([[2**30, 3, 5]]), np.array([[2**30, 1, 1], [-(2**30), 0, 1], [2**40, 0, 0]])
    assert G.products(*a).tolist() == [[2**60 + 8, 5 - 2**60, MOST]]


def test_rows_that_take_no_part(spark):
    rows = vectors(3, 80) + [(200, None, 1), (210, [1.0, None], 1), (220, [float("nan")] * 6, 1), (230, [float("inf")] * 6, 2), (240, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    assert found(spark, rows) == brute(rows)


def test_unlike_lengths_and_empty_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0], 0), (2, [1.0, 1.0, 9.0], 0), (3, [], 0), (4, [1.0, 1.5], 1), (5, [], 1), (10, [], 1)]
    assert found(spark, rows) == brute(rows) != []


def test_repeated_rows_and_clashing_columns(spark):
    rows = vectors(4, 60)
    twice = rows + rows[:20]
    df = spark.createDataFrame(twice, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "vec", "anchor", "place", "rank")})
    got = sorted(tuple(r) for r in G.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(twice)


def test_empty_tables_and_no_anchors(spark):
    out = G.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == [] == found(spark, [(10, [1.0], 0), (2, [1.0], 1)])
    assert G.hard_negatives(spark.createDataFrame([(10, [1.0], 0)], SCHEMA), F.lit(None).cast("boolean")).collect() == []
