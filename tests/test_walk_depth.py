"""Entities are found however deep they are nested."""

from __future__ import annotations

import json

from tidemark.operators import catalog


def test_entities_nested_deep(spark):
    node, want = None, []
    for i in range(40):
        node = {"entityId": {"id": str(i)}, "entityType": "ASSET", "name": f"n{i}", "type": "T", "children": [node] if node else []}
        want.append((1, str(i), f"n{i}"))
    texts = spark.createDataFrame([(1, json.dumps(node)), (2, "[[]]"), (3, "no json")], "k int, t string")
    assert sorted(map(tuple, catalog.walk_entities(texts, "t").collect())) == sorted(want)
    assert catalog.walk_types(texts, "t").count() == 40
