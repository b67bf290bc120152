from datetime import datetime

from emberlake.plans import areas


def test_groups_by_the_larger_radius_and_lone_places(spark, monkeypatch):
    """A wide pixel draws a narrow one in either order; a lone place is a group that no component round sees."""
    seen = []
    find = areas.connected_components
    monkeypatch.setattr(areas, "connected_components", lambda edges: (seen.extend(r for r in edges.collect()), find(edges))[1])
    step = 1_200 / areas.MPD
    rows = [("a", 1.0, 40.0, 1500.0), ("b", 1.0, 40.0 + step, 650.0), ("c", 1.0, 40.0 + 2 * step, 650.0), ("d", 1.0, 40.0 + 2 * step, 650.0), ("e", 1.0, 40.0 - step, 650.0), ("f", 5.0, 41.0, 1500.0)]
    points = spark.createDataFrame([(i, lon, lat, "2024-01-01", "viirs", r, datetime(2024, 1, 1)) for i, lon, lat, r in rows],
                                   "id string, longitude double, latitude double, day string, family string, radius_m double, observed_at timestamp")
    groups = {}
    for r in areas.group_detections(points).collect():
        groups.setdefault(r.group, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "e"], ["c", "d"], ["f"]]
    assert len(seen) == 2 and all(r.src != r.dst for r in seen)
