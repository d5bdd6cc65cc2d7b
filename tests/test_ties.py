"""Choices that an ORDER BY leaves open are the same for any order and division of the rows."""

from types import SimpleNamespace

from wayfault.plans import lrs_queries as R


def test_longest_overlap_does_not_vary(spark):
    """Two types of one number: the choice does not depend on how rows come."""
    matches = spark.createDataFrame([(k, 0, 0, k, 1, 0.0, 10.0) for k in range(40)], "_idx_ long, u long, v long, key long, route_id long, min_from_mi double, max_to_mi double")
    events = spark.createDataFrame([(1, 0.0, 5.0, 11, None)], "event_route_id long, from_measure double, to_measure double, functional_class long, to_date string")
    types = [(11, "11", "Y", 2), (11, "11", "N", 3), (11, "11", "N", 1)]
    for order in (types, types[::-1], types[1:] + types[:1]):
        t = SimpleNamespace(lrs_matches=matches, lrs_events=events, class_types=spark.createDataFrame(order, "type_id long, type_functional_class string, federal_aid_flag string, class_hierarchy long").coalesce(1))
        assert {(r.federal_aid_flag, r.class_hierarchy) for r in R.longest(t).collect()} == {("N", 1)}
