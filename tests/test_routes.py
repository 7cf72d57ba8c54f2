"""Routes for a table of station pairs: direct, by an interchange, or none."""

import math

from pyspark.sql import functions as F

from covgrid.functions import expr as E
from covgrid.operators import geometry as G
from covgrid.plans import rail as RL


def network(spark):
    """A and B run north, far apart; two bridges cross both; C is alone.  Stations by line and metres."""
    lines = {"A": [(600e3, 6500e3), (600e3, 6560e3)], "B": [(650e3, 6500e3), (650e3, 6560e3)],
             "P": [(590e3, 6510e3), (660e3, 6510e3)], "Q": [(590e3, 6550e3), (680e3, 6550e3)],
             "C": [(900e3, 6500e3), (900e3, 6520e3)]}
    v = [(k, i, 0, n, x, y) for i, (k, p) in enumerate(lines.items()) for n, (x, y) in enumerate(p)]
    at = [("a1", "Nord", "A", 600e3, 6558e3), ("a2", "Centre", "A", 600e3, 6511e3), ("a3", "Sud", "A", 600e3, 6501e3),
          ("b1", "Port", "B", 650e3, 6530e3), ("p1", "Pont", "P", 601e3, 6510e3), ("q1", "Quai", "Q", 600.5e3, 6550e3),
          ("c1", "Seul", "C", 900e3, 6500e3), ("q2", "Centre", "Q", 679e3, 6550e3)]
    vertices = spark.createDataFrame(v, "line_id string, feature long, part int, seq int, x double, y double")
    st = spark.createDataFrame(at, "station_id string, station_name string, line_code string, x double, y double")
    lon, lat = E.lambert_lonlat("x", "y")
    st = st.select("station_id", "station_name", "line_code", F.lit("").alias("commune"), F.lit("").alias("department"),
                   lat.alias("latitude"), lon.alias("longitude"))
    return vertices, G.lines_table(vertices, st), st


def test_routes(spark):
    vertices, lines, st = network(spark)
    pairs = [(1, "Nord", "Sud"), (2, "Nord", "Port"), (3, "Nord", "Seul"), (4, "Nord", "Nowhere"), (5, "Centre", "Quai"),
             (6, "Sud", "Port"), (7, "Nord", "Port")]
    df = spark.createDataFrame(pairs, "pair_id long, dep_station string, arr_station string")
    rows = RL.routes(df, vertices, lines, st).collect()
    kinds = {p: {r.kind for r in rows if r.pair_id == p} for p, _, _ in pairs}
    assert kinds == {1: {"direct"}, 2: {"transfer"}, 3: {"none"}, 4: {"none"}, 5: {"direct"}, 6: {"transfer"}, 7: {"transfer"}}
    assert [r.line_id for r in rows if r.pair_id in (1, 5)] in (["A", "Q"], ["Q", "A"])
    pos = {r.station_name: r for r in RL.station_positions(st, st.select("station_name")).collect()}
    for p, dep, arr in pairs[1:2] + pairs[5:6]:  # as the search for one pair gives it
        one = RL.transfers(vertices, lines, st, ["A"], ["B"], pos[dep].latitude, pos[dep].longitude, pos[arr].latitude,
                           pos[arr].longitude).collect()
        mine = sorted((r for r in rows if r.pair_id == p), key=lambda r: r.option)
        assert [(r.line_id, r.length_km, r.transfer_station) for r in mine] == [
            (r.line_id, r.length_km, r.transfer_station) for r in one] and len(one) == 2
        assert {r.transfer_station for r in one} == {"Quai", "Centre"}  # a tie with Pont goes to the smaller id
    assert [r.option for r in rows if r.pair_id == 3] == [None]
    assert RL.routes(df.limit(0), vertices, lines, st).count() == 0


def test_nearest_of_group_in_blocks(spark):
    """The nearest station of a point's own group, ties to the smaller id, whatever the blocks."""
    points = spark.createDataFrame([(g, f, f % 3, float(f * 7 % 11), float(f)) for g in "ab" for f in range(20)],
                                   "g string, feature long, fa long, x double, y double")
    rows = [("a", "s2", "two", 4.0, 4.0), ("a", "s1", "one", 4.0, 4.0), ("a", "s3", "three", 9.0, 15.0), ("b", "s9", "nine", 0.0, 0.0),
            ("c", "s0", "none", 1.0, 1.0)]
    stations = spark.createDataFrame(rows, "g string, station_id string, station_name string, sx double, sy double")
    out = RL.nearest_of_group(points, stations, "g", block=3).collect()
    assert len(out) == 40 and out[0].asDict().keys() == {"g", "feature", "fa", "near"}
    for r in out:
        x, y = float(r["feature"] * 7 % 11), float(r["feature"])
        want = min((math.sqrt((x - s[3]) ** 2 + (y - s[4]) ** 2), s[1], s[2]) for s in rows if s[0] == r["g"])
        assert (r["near"]["station_id"], r["near"]["station_name"]) == want[1:] and abs(r["near"]["d"] - want[0]) < 1e-9


def test_bridges_in_rounds(spark, monkeypatch):
    """Bridges met in rounds give what all at once give, pairs that have all their options leave, and the contacts of all
    lines are never held at once: near lines are as many as the square of the lines."""
    v, st = [], []
    for i in range(36):  # 18 lines east, 18 north, each crossing all of the other kind; lengths in fives
        n, far = i // 2, 60e3 + 2e3 * (i % 10 // 2)
        at = [(600e3 + far * t, 6500e3 + 3e3 * n) if i % 2 else (600e3 + 3e3 * n, 6500e3 + far * t) for t in (0, 0.5, 1)]
        v += [(f"L{i:02}", i, 0, k, x, y) for k, (x, y) in enumerate(at)]
        st += [(f"s{i:02}{k}", f"Gare {(i * 5 + k * 7) % 23}", f"L{i:02}", x, y) for k, (x, y) in enumerate(at)]
    v += [("X", 50, 0, 0, 100e3, 6200e3), ("X", 50, 0, 1, 110e3, 6200e3), ("Y", 51, 0, 0, 100e3, 6202e3), ("Y", 51, 0, 1, 109e3, 6202e3),
          ("Z", 52, 0, 0, 105e3, 6199e3), ("Z", 52, 0, 1, 105e3, 6204e3)]  # two lines apart, joined by the shortest of all
    st += [("x", "Ici", "X", 100e3, 6200e3), ("y", "Là", "Y", 100e3, 6202e3), ("z", "Milieu", "Z", 105e3, 6201e3)]
    vertices = spark.createDataFrame(v, "line_id string, feature long, part int, seq int, x double, y double")
    lon, lat = E.lambert_lonlat("x", "y")
    stations = spark.createDataFrame(st, "station_id string, station_name string, line_code string, x double, y double").select(
        "station_id", "station_name", "line_code", lat.alias("latitude"), lon.alias("longitude"))
    pairs = spark.createDataFrame([(i, f"Gare {i % 23}", f"Gare {i * 7 % 25}") for i in range(40)] + [(90, "Ici", "Là")],
                                  "pair_id long, dep_station string, arr_station string")
    lines = G.lines_table(vertices, stations)
    held, left, store = [], [], RL.materialize

    def counted(df, name="stage"):
        out = store(df, name)
        if name in ("contacts", "left"):
            (held if name == "contacts" else left).append(out.count())
        return out

    monkeypatch.setattr(RL, "materialize", counted)
    key = lambda df: sorted((r.pair_id, r.option or 0, repr(r)) for r in df.select(sorted(df.columns)).collect())
    want = key(RL.routes(pairs, vertices, lines, stations, limit=2))
    everything, = held
    held.clear()
    left.clear()
    got = key(RL.routes(pairs, vertices, lines, stations, limit=2, rounds=(3, 6), one_round=5))
    assert got == want and len(held) == 3 and left[0] > 3 * left[-1] > 0
    assert sum(held) < everything / 2
    assert any(p == 90 and "'Milieu'" in r for p, _, r in got)  # by the last bridge
