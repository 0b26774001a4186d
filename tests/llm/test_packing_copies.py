"""Copies of a text that outnumber the containers."""

from collections import Counter

import numpy as np

from brepflow.llm import packing


def test_copies_are_spread_evenly():
    sizes, clusters = np.array([10] * 20 + [80] * 10), np.array([0] * 20 + list(range(1, 11)))
    place = packing.best_fit(sizes, clusters, np.zeros(30, int), 100)
    assert max(Counter(place[:20].tolist()).values()) == 2
    assert len(set(place.tolist())) == 10


def test_sources_stay_apart_and_equal_rows_spread(spark):
    rows = [(i, "ab"[i % 2], i, 30 + i % 50) for i in range(900)] + [(None, "a", -1, 7)] * 300
    t = spark.createDataFrame(rows, "doc_id bigint, source string, cluster bigint, size int").repartition(4)
    packed = packing.pack(t, 100, (("a", "b"),), group_items=100)
    report = packing.rules_report(packed, t, 100, (("a", "b"),)).first()
    assert report.asDict() == {"n_documents": 901, "n_split_needlessly": 0, "n_above_capacity": 0, "n_apart_together": 0}
    groups = Counter(r.container_id >> 32 for r in packed.filter("doc_id is null").collect())
    assert sum(groups.values()) == 300 and max(groups.values()) < 100


def test_order_puts_clusters_of_more_copies_first():
    assert packing._copies(np.array([5, 7, 5, 5])).tolist() == [3, 1, 3, 3]
