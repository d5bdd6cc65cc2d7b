"""Small road networks derived from the suppliers; whole numbers as costs, so sums are exact.

Every supplier has streets within its block of ten and one to the next block; four blocks make a component."""

from __future__ import annotations

from wayfault.plans.registry import ADAPTERS, adapter

adapter(
    "edges",
    """SELECT u, v, CAST(0 AS BIGINT) AS key, min(tt) AS travel_time, min(len) AS length FROM (
       SELECT s_suppkey AS u, s_suppkey - s_suppkey % 10 + (s_suppkey * 7 + 3) % 10 AS v, 100 + s_suppkey * 37 % 91 AS tt, CAST(1 + s_nationkey AS BIGINT) AS len FROM supplier
       UNION ALL SELECT s_suppkey - s_suppkey % 10 + (s_suppkey * 3 + 1) % 10, s_suppkey, 100 + s_suppkey * 53 % 97, CAST(2 + s_nationkey AS BIGINT) FROM supplier
       UNION ALL SELECT s_suppkey, CASE WHEN CAST(floor(s_suppkey / 10) AS BIGINT) % 4 = 3 THEN s_suppkey ELSE s_suppkey + 10 END, 300 + s_suppkey % 83, CAST(9 AS BIGINT) FROM supplier
       ) WHERE u <> v GROUP BY u, v""",
)
adapter("mesh", ADAPTERS["edges"])
adapter(
    "edge_tags",
    """SELECT u, v, key, travel_time, length,
       CASE (u + v) % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'Trunk_link' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary_link' WHEN 4 THEN 'living_street' WHEN 5 THEN 'service' WHEN 6 THEN 'footway' ELSE 'residential' END AS h1,
       CASE u % 5 WHEN 0 THEN 'tertiary' WHEN 1 THEN 'primary_link' WHEN 2 THEN 'service' ELSE NULL END AS h2,
       CASE v % 3 WHEN 0 THEN 'driveway' WHEN 1 THEN 'alley' ELSE NULL END AS service,
       CASE WHEN u % 3 = 0 THEN concat('US ', CAST(u % 12 AS STRING)) ELSE NULL END AS ref, CASE WHEN v % 4 <> 0 THEN concat('Street ', CAST((u + v) % 9 AS STRING)) ELSE NULL END AS name,
       CASE WHEN u * v % 5 = 0 THEN 'yes' WHEN u * v % 5 = 1 THEN 'no' WHEN u * v % 5 = 2 THEN 'viaduct' ELSE NULL END AS bridge,
       CASE (u + 2 * v) % 4 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'Gravel' WHEN 2 THEN NULL ELSE 'dirt' END AS surface,
       CASE u % 4 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN 'signals' ELSE NULL END AS maxspeed
       FROM edges""",
)
adapter("mesh_tags", ADAPTERS["edge_tags"].replace("FROM edges", "FROM mesh"))
