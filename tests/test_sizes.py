"""What only shows with several files, many rows or dense neighbours."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.frame import Samples
from tidemark.operators import dedup
from tidemark.sources.files import load_raw, read_data


def rows_of(spark, v, kind="double"):
    return spark.createDataFrame([(7 * i, [float(x) for x in r]) for i, r in enumerate(v)], f"_ord long, vec array<{kind}>").repartition(3)


@pytest.fixture
def sent(monkeypatch):
    """Rows given to a shuffle by a search."""
    seen, plain = [], dedup.meeting

    def meeting(packed, groups):
        ids = [F.coalesce(F.size(c), F.lit(0)) for c in ("_ord", "l", "r") if c in packed.columns]
        seen.append(packed.select(F.sum(sum(F.greatest(x, F.lit(0)) for x in ids))).first()[0])
        return plain(packed, groups)

    monkeypatch.setattr(dedup, "meeting", meeting)
    return seen


def test_lines_are_numbered_by_file(spark, tmp_path):
    folder = tmp_path / "many.jsonl"
    folder.mkdir()
    want = []
    for k, n in enumerate([1, 40, 3, 200, 0, 7, 90, 2, 5, 60, 1, 30]):  # Spark reads the large ones first
        lines = [f"{k}:{i}" for i in range(n)]
        (folder / f"part-{k}.json").write_text("".join(f'{{"id": "{x}", "question": "{x}"}}\n' for x in lines))
        want += lines
    assert [(r["id"], r["_ord"]) for r in read_data(spark, str(folder)).to_list()] == [(x, i) for i, x in enumerate(want)]
    assert [r.question for r in load_raw(spark, str(folder), 50).orderBy("_ord").collect()] == want[:50]
    table = tmp_path / "many.csv"
    table.mkdir()
    for k, n in enumerate([1, 50, 4]):
        (table / f"part-{k}.csv").write_text("id\n" + "".join(f"{k}:{i}\n" for i in range(n)))
    assert [r["id"] for r in read_data(spark, str(table)).to_list()] == [f"{k}:{i}" for k, n in enumerate([1, 50, 4]) for i in range(n)]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_nearest_of_many_ties(spark, sent, monkeypatch, kind):
    """equal products, equal rows and rows of zeros, in several tiles and blocks; a row is sent a few times."""
    monkeypatch.setattr(dedup, "TILE", 64)
    v = np.random.default_rng(3).integers(-1, 2, (2500, 6)).astype(float)
    df = rows_of(spark, v, kind)
    u = dedup.unit(v)
    sim = np.round(u @ u.T, 6) + 0.0
    np.fill_diagonal(sim, -np.inf)
    want = {(7 * i, 7 * int(j), sim[i, j]) for i in range(len(v)) for j in np.argsort(-sim[i], kind="stable")[:5]}
    left, right = df.select(F.col("_ord").alias("l"), "vec"), df.select(F.col("_ord").alias("r"), "vec")
    assert {(r.l, r.r, r.sim + 0.0) for r in dedup.nearest(left, right, 5, 6, other=True).collect()} == want
    dot = v[:40] @ v.T
    best = {(7 * i, 7 * int(np.argmax(dot[i]))) for i in range(40)}
    assert {(r.l, r.r) for r in dedup.nearest(left.where("l < 280"), right, 1, 9, cosine=False).collect()} == best
    assert dedup.nearest(left, right.limit(0), 5, 6).count() == 0 == dedup.nearest(left.limit(0), right, 5, 6).count()
    many = rows_of(spark, np.ones((30_000, 1)))
    sent.clear()
    dedup.nearest(many.select(F.col("_ord").alias("l"), "vec"), many.select(F.col("_ord").alias("r"), "vec"), 1, 6)
    assert sent[0] <= 15 * 30_000  # twice 15 before, and more with more rows


def test_pairs_send_rows_a_few_times(spark, sent, monkeypatch):
    """F8, F5: as many times for 30,000 rows as for any up to a million of 64 numbers."""
    monkeypatch.setattr(dedup, "TILE", 64)
    v = np.random.default_rng(4).integers(-1, 2, (2500, 6)).astype(float)
    u = dedup.unit(v)
    i, j = np.nonzero(np.triu(np.round(u @ u.T, 9) >= 0.9, 1))
    want = set(zip((7 * i).tolist(), (7 * j).tolist()))
    assert {(r.i, r.j) for r in dedup.block_pairs(rows_of(spark, v), 0.9).collect()} == want
    sparse = spark.createDataFrame([(7 * k, [int(x) for x in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for k, r in enumerate(u)], "_ord long, idx array<int>, val array<double>")
    assert {(r.i, r.j) for r in dedup.block_pairs(sparse, 0.9).collect()} == want
    assert dedup.block_pairs(sparse.limit(0), 0.9).count() == 0
    sent.clear()
    dedup.block_pairs(rows_of(spark, np.ones((30_000, 1))), 0.9)
    assert sent[0] <= 12 * 30_000
    assert dedup.Form(64, 64, "f4").blocks(1_000_000) <= 12 and dedup.Form(128, 128, "f8").blocks(670_000) <= 12


@pytest.mark.parametrize("sparse", [False, True])
def test_greedy_without_all_pairs(spark, monkeypatch, sparse):
    """3,000 rows of which most have hundreds of neighbours; a list of their pairs isn't made."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((12, 8))[rng.integers(0, 12, 3000)] + 0.15 * rng.standard_normal((3000, 8))
    u = dedup.unit(v)
    near, gone = np.round(u @ u.T, 9) >= 0.95, np.zeros(len(v), bool)
    for i in range(len(v)):
        if not gone[i]:
            gone[i + 1 :] |= near[i, i + 1 :]
    df = rows_of(spark, v)
    if sparse:
        df = spark.createDataFrame([(7 * k, list(range(8)), [float(x) for x in r]) for k, r in enumerate(u)], "_ord long, idx array<int>, val array<double>")
    want, made, plain = {7 * int(i) for i in np.flatnonzero(gone)}, [], dedup.block_pairs

    def listed(*args):
        made.append((found := plain(*args)).count())
        return found

    monkeypatch.setattr(dedup, "block_pairs", listed)
    for head, small in ((50, 2000), (200, 0), (4000, 2000)):
        assert {r._ord for r in dedup.greedy_near(df, 0.95, head=head, small=small).collect()} == want
    assert sum(made) < near.sum() / 100
    twice = df.union(df.limit(100))  # several rows with one place
    assert {r._ord for r in dedup.greedy_near(twice, 0.95).collect()} == want
    assert dedup.greedy_near(df.limit(0), 0.95).count() == 0


def test_pairs_meet_once(spark, sent, monkeypatch):
    """any two blocks meet in one task, a row is sent six times, and so few times more with many more rows."""
    for q in (0, 5, 7, 11, 13):
        n, at = q * q + q + 1, dedup.plane(q)
        assert at[0] == 0 and len(at) == q + 1
        assert sorted((x - y) % n for x in at for y in at if x != y) == list(range(1, n))
    sizes = [dedup.Form(128, 128, "f8").meetings(n) for n in (1000, 10_000, 684_000, 1_000_000, 10_000_000)]
    assert [len(at) for _, at in sizes] == [1, 6, 6, 6, 54]
    v = np.random.default_rng(6).integers(-1, 2, (3000, 6)).astype(float)
    u = dedup.unit(v)
    i, j = np.nonzero(np.triu(np.round(u @ u.T, 9) >= 0.8, 1))
    want = sorted(zip((7 * i).tolist(), (7 * j).tolist()))
    assert sorted((r.i, r.j) for r in dedup.block_pairs(rows_of(spark, v), 0.8).collect()) == want
    assert sent == [6 * 3000]
    monkeypatch.setattr(dedup, "HELD", 6400)  # as if there were far more rows: 133 blocks
    assert sorted((r.i, r.j) for r in dedup.block_pairs(rows_of(spark, v), 0.8).collect()) == want
    assert sent[1] == 12 * 3000


@pytest.mark.parametrize("sparse", [False, True])
def test_greedy_where_places_have_several_rows(spark, monkeypatch, sparse):
    """rows of one place go together and are near what any of them is near; the list of pairs isn't made."""
    rng = np.random.default_rng(8)
    v = dedup.unit(rng.standard_normal((60, 8))[rng.integers(0, 60, 3000)] + 0.15 * rng.standard_normal((3000, 8)))
    place = np.arange(3000)
    place[rng.choice(3000, 700, replace=False)] = rng.integers(0, 3000, 700)
    near, gone = np.round(v @ v.T, 9) >= 0.95, np.zeros(3000, bool)
    rows = [np.flatnonzero(place == k) for k in range(3000)]
    alone = set()
    for k in range(3000):
        if len(rows[k]) and not gone[k]:
            hit = near[rows[k]].any(axis=0)
            later = np.unique(place[hit])
            gone[later[later > k]] = True
            alone |= {int(x) for x in later[later > k] if not hit[rows[x]].all()}
    assert alone  # places of which one row is near and another isn't
    if sparse:
        df = spark.createDataFrame([(int(k), list(range(8)), [float(x) for x in r]) for k, r in zip(place, v)], "_ord long, idx array<int>, val array<double>")
    else:
        df = spark.createDataFrame([(int(k), [float(x) for x in r]) for k, r in zip(place, v)], "_ord long, vec array<double>").repartition(3)
    made, plain = [], dedup.block_pairs

    def listed(*args):
        made.append((found := plain(*args)).count())
        return found

    monkeypatch.setattr(dedup, "block_pairs", listed)
    want = set(np.flatnonzero(gone).tolist())
    for head, small in ((50, 2000), (200, 0), (4000, 2000)):
        assert {r._ord for r in dedup.greedy_near(df, 0.95, head=head, small=small).collect()} == want
    assert sum(made) < near.sum() / 10
    made.clear()
    most = max(len(r) for r in rows)
    assert {r._ord for r in dedup.greedy_near(df, 0.95, head=most - 1).collect()} == want and made  # too many of one place for the driver


def test_positions_without_all_rows_on_the_driver(spark, monkeypatch):
    """a limit or an offset that is collected brings as many rows of each task to the driver."""
    ords = sorted([5 * i * i for i in range(2000)] + [20, 20, 5 * 1500**2])  # three rows have one place, two another
    rows = [(f"{o}-{k}", "other", o) for k, o in enumerate(ords)]
    s = Samples.from_list(spark, [])
    s = Samples(s.df.unionByName(spark.createDataFrame(rows, "id string, category string, _ord long").repartition(5), allowMissingColumns=True))
    kind, seen = type(s.df), []
    plain = kind.offset
    monkeypatch.setattr(kind, "offset", lambda df, n: (seen.append(n), plain(df, n))[1])
    for at in (0, 7, 99, 100, 1000, 1502, 1503, 2002, -1, -100, -101, -2003):
        assert s[at]["_ord"] == ords[at], at
    assert {s[k]["id"] for k in (1502, 1503)} == {r[0] for r in rows if r[2] == 5 * 1500**2}
    for at in (2003, -2004, 10**6):
        with pytest.raises(IndexError):
            s[at]
    for lo, hi in ((0, 5), (3, 400), (1502, 1504), (1503, 1700), (1990, 5000), (-3, 2003), (50, 50), (300, 200)):
        assert sorted(r["_ord"] for r in s[lo:hi].to_list()) == ords[lo:hi]
    assert max(seen) < 100
