from datetime import datetime

from tessera.operators import equivalence


def test_more_than_fifty_changes(spark):
    """A chain of equalities and one of splits, each beyond fifty hops, and what is not linked."""
    n = 56
    at = [datetime(1900 + i, 1, 1) for i in range(n + 2)]
    objects = spark.createDataFrame([(f"o{i}", at[i], None, at[i + 1]) for i in range(n + 1)] + [("z", at[0], None, at[1])], "object_id string, exists_from timestamp, exists_at timestamp, exists_to timestamp")
    events = spark.createDataFrame([(f"s{n - 1}", "SPLIT", f"e{n - 1}")], "object_id string, event_type string, event_id string")
    parts = spark.createDataFrame([(f"e{n - 1}", "p1"), (f"e{n - 1}", "p2"), ("other", "q")], "event_id string, object_id string")
    equals = spark.createDataFrame([(f"o{i}", f"o{i + 1}") for i in range(n)] + [(f"o{n}", f"s{n - 1}")], "subject string, object string")
    near = equivalence.neighbourhood(events, parts, equals, spark.createDataFrame([("o0",)], "id string"))
    assert sorted(r.object_id for r in near.collect()) == sorted([f"o{i}" for i in range(n + 1)] + [f"s{n - 1}", "p1", "p2"])
    # the walk over the whole chain
    found = equivalence.equivalent(objects, events.limit(0), parts, equals.where(f"object <> 's{n - 1}'"), ["o0"], at[n])
    assert found == {f"o{n}"}
