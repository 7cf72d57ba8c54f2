"""Point clusters that no tile or cell border cuts, against a loop over the cells."""

import math
import random

from covgrid.plans import antennas as A
from covgrid.schema import SITES_SCHEMA


def expected(points, zoom):
    cells = {}
    for lat, lon in points:
        n = 2.0 ** zoom * 5.12
        r = math.radians(lat)
        x, y = (lon + 180) / 360 * n, (1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n
        cells.setdefault((math.floor(x), math.floor(y)), []).append((x, y))
    at = {k: [sum(v) / len(p) for v in zip(*p)] for k, p in cells.items()}
    rank = lambda k: (-len(cells[k]), k)
    near = {a: [b for b in cells if b != a and math.dist(at[a], at[b]) <= 1 and rank(b) < rank(a)] for a in cells}
    out = {}
    for a in cells:
        seeds = sorted((b for b in near[a] if not near[b]), key=rank)
        owner = seeds[0] if seeds else a
        n, c = out.get(owner, (0, 0))
        out[owner] = (n + len(cells[a]), c + 1)
    return out


def test_merged_clusters(spark):
    rng = random.Random(3)
    points = [(45 + rng.gauss(0, 0.3), 2 + rng.gauss(0, 0.3)) for _ in range(150)] + [(46.0, 5.0)] * 20 + [(60.0, 2.0)]
    sites = spark.createDataFrame([(i, "OF", *p, None, None, None, "4G") for i, p in enumerate(points)], SITES_SCHEMA)
    got = {}
    for r in A.merged_clusters(sites).collect():
        got.setdefault(r["zoom"], {})[r["cell_x"], r["cell_y"]] = (r["point_count"], r["cells"])
    assert set(got) == set(range(7, 15))
    for zoom, clusters in got.items():
        assert clusters == expected(points[:-1], zoom)  # the last point lies outside the box
    assert any(c > 1 for clusters in got.values() for _, c in clusters.values())
    assert A.merged_clusters(sites.limit(0)).count() == 0
