"""Vectors whose squares leave the range of doubles link like any other."""

from attrix.llm.embedding_dedup import embedding_dedup


def test_very_small_and_very_large_vectors(spark):
    tiny, huge, least = 1e-170, 1e200, 5e-324
    rows = [(1, [tiny, 2 * tiny]), (2, [3 * tiny, 6 * tiny]), (3, [huge, 2 * huge]), (4, [1.0, 2.0]), (5, [2 * huge, -huge]), (6, [1.7e308, -0.85e308]),
            (7, [least, 0.0]), (8, [1.0, 0.0]), (9, [float("inf"), 1.0]), (10, [0.0, 0.0]), (11, None), (12, [float("nan"), 1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup(table).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7), 9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (0, 12)}
