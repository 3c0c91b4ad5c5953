"""Bootstrap means on chunks, and evaluations that are read once."""

import hashlib

from pyspark.sql import functions as F

from lodeloom.operators import report, resamples


def test_draws_on_chunks_equal_draws_on_whole_groups(spark, monkeypatch):
    """No row holds a group, and the means are those of the drawn places, however values and draws are cut."""
    monkeypatch.setattr(resamples, "CHUNK", 16)
    monkeypatch.setattr(resamples, "CELLS", 400)
    sizes = {"a": 101, "b": 101, "c": 7}
    rows = [(g, n, k, (k * 37 % 11) / 7 + ord(g)) for g, n in sizes.items() for k in range(n)]
    stored = resamples.Resamples(spark.createDataFrame(rows, "g string, n long, pos long, v double"), ["g"], ["v"])
    assert stored.chunks.agg(F.max(F.size("v"))).first()[0] == 16
    got = {(r["g"], r["draw"]): r["v"] for r in stored.means(30).collect()}
    assert len(got) == 90
    for g, n in sizes.items():
        own = [v for name, _, _, v in rows if name == g]
        for draw in (0, 9, 29):
            places = [int(hashlib.md5(f"42:{draw}:{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]
            assert abs(got[(g, draw)] - sum(own[p] for p in places) / n) < 1e-9
    assert {r["g"]: round(r["v"], 6) for r in stored.totals().collect()} == {g: round(sum(v for name, _, _, v in rows if name == g), 6) for g in sizes}


def test_what_aspects_add_reads_the_table_once(spark):
    schema = "system string, split string, metric string, mean double, vs_baseline string, diff double, significant boolean"
    rows = [("a", "all", "acs", 0.5, "b", 0.25, True), ("b", "all", "acs", 0.25, None, None, None), ("c", "all", "acs", 0.75, "b", 0.5, False), ("a", "en", "acs", 9.0, "b", 9.0, True)]
    table = spark.createDataFrame(rows, schema).mapInArrow(lambda batches: batches, schema)
    got = report.aspect_contribution(table, [("a", "b"), ("c", "a"), ("a", "none")])
    assert sorted(map(tuple, got.collect())) == [("a", "b", "acs", 0.25, True), ("c", "a", "acs", 0.25, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
