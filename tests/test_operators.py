"""Clusters, similarity, ordering, sweeps, files, text functions and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tierlab.functions import text as X
from tierlab.operators import clusters as C
from tierlab.operators import ordering as O
from tierlab.operators import policy as P
from tierlab.operators import similarity as M
from tierlab.operators import sweep as W
from tierlab.plans.registry import ORACLES, QUERIES
from tierlab.sources import bindings as B
from tierlab.sources import files as L
from tierlab.streaming import observe as V

SF = "/root/testdata/sf0.001"


def test_cluster_fixture(spark):
    rows = [(1, 0, "ok", True, 10, 8), (1, 1, "ok", True, 10, 2), (1, 2, "ok", True, 10, 9), (1, 3, "refuted:5", False, 10, None)]
    c = spark.createDataFrame(rows, "problem_id long, idx long, behaviour string, verified boolean, bytes long, complexity long")
    got = {r["behaviour"]: r for r in C.ranked(C.clusters(c)).collect()}
    assert got["ok"]["mass"] == 0.75 and got["ok"]["representative"] == 1 and got["ok"]["place"] == 1
    assert 0 < C.routing_score(C.clusters(c)).first()["score"] < 0.75


def test_text_vote_ties_go_to_the_first(spark):
    c = spark.createDataFrame([(1, 0, "a  b"), (1, 1, "c"), (1, 2, "c "), (1, 3, "a b")], "problem_id long, idx long, source string")
    r = C.text_vote(c, X.raw_text_key(F.col("source"))).first()
    assert (r["winner"], r["votes"], r["mass"]) == (0, 2, 0.5)


def test_similarity(spark):
    q = spark.createDataFrame([(0, "Sort a list of numbers quickly"), (1, "ab"), (2, "")], "id long, text string")
    s = spark.createDataFrame([(10, "sort a list of  numbers quickly", 0.1), (11, "Sort a list of numbers quick", 0.9), (12, "entirely different", 0.5), (13, "AB", 0.2)], "id long, text string, score double")
    got = [(r["a"], r["b"], round(r["sim"], 2)) for r in M.retrieve(q, s).orderBy("a", "place").collect()]
    assert got == [(0, 10, 1.0), (0, 11, 0.93), (1, 13, 1.0)]


def test_trigrams(spark):
    df = spark.createDataFrame([("é\U0001f600a b",), ("ab",), ("",), (None,)], "t string").select(X.trigrams(F.col("t")).alias("g"))
    assert [r["g"] for r in df.collect()] == [["é\U0001f600a", "\U0001f600a ", "a b"], [], [], []]


def test_stable_rank_matches_a_sort(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 5).alias("x"))
    got = {r["id"]: r["p"] for r in O.stable_rank(df, {"x": True}, "id", "p").collect()}
    want = {r["id"]: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r["x"], r["id"])))}
    assert got == want
    r = O.value_at(df, "x", {"median": F.expr("n div 2"), "p90": F.expr("9 * n div 10")}).first()
    assert (r["n"], r["median"], r["p90"]) == (1000, 2, 4)


def test_sweep_invariants(spark):
    rows = {(r["pattern"], r["rho"], r["epsilon"]): r for r in W.absorption_sweep(B.records(spark, SF), ["easy-first", "uniform"], [0.0, 0.3, 0.6], 0.2, 0.1, [0.4, 0.3], [0.0, 0.01, 1.0]).collect()}
    assert rows["easy-first", 0.0, 0.0]["deployed_risk"] == rows["uniform", 0.0, 0.0]["deployed_risk"]
    easy = [rows["easy-first", r, 0.0]["tier0_accuracy"] for r in (0.0, 0.3, 0.6)]
    assert easy[0] > easy[1] > easy[2] and easy[0] == rows["uniform", 0.3, 0.0]["tier0_accuracy_d"]
    n = rows["uniform", 0.0, 0.0]["n_residual"]
    assert rows["uniform", 0.3, 0.0]["n_residual"] == n - int(0.3 * n + 0.5)
    for (_, _, eps), r in rows.items():
        if eps == 0:
            assert r["n_calibration"] == n and r["n_shadow"] == 0
        elif eps == 1:  # a whole shadow stream closes the gap, but for labels that differ from the truth
            assert r["n_shadow"] == r["n_residual"]
        else:
            assert r["n_shadow"] == max(1, round(0.01 * r["n_residual"]))
        assert r["underpowered"] == (r["n_calibration"] < 11) == (r["note"] != "")


def test_whole_shadow_stream_closes_the_gap(spark):
    from test_policy import make

    r = make(spark, [([(0.9 if i % 10 else 0.2, i % 10 > 0, 1), (1.0, i % 5 > 0 or i % 10 > 0, 3)], {}) for i in range(400)])
    sweep = {(x["rho"], x["epsilon"]): x for x in W.absorption_sweep(r, ["easy-first"], [0.0, 0.5], 0.3, 0.1, [0.5], [0.0, 1.0]).collect()}
    assert sweep[0.5, 1.0]["risk_gap"] == 0 and sweep[0.5, 0.0]["risk_gap"] > 0
    with pytest.raises(ValueError):
        W.absorption_sweep(r, ["easy-first"], [1.0], 0.3, 0.1, [0.5])


def test_envelope_counts_seeds_and_flags(spark):
    records = B.records(spark, SF)
    e = W.null_envelope(records, [0.0, 0.3, 0.6], 0.2, 0.1, [0.4, 0.3], [1, 2, 3])
    rows = W.absorption_sweep(records, ["uniform"], [0.3, 0.6], 0.2, 0.1, [0.4, 0.3], seeds=[1, 2, 3]).where("certified").collect()
    got = e.first()
    assert got["n_draws"] == len(rows) == 6 and got["max_abs_gap"] == max(abs(r["risk_gap"]) for r in rows)
    assert len({r["risk_gap"] for r in rows}) > 3
    flags = W.significant(W.absorption_sweep(records, ["easy-first"], [0.0, 0.6], 0.2, 0.1, [0.4, 0.3]), e).collect()
    assert [r["significant"] for r in sorted(flags, key=lambda r: r["rho"])][0] is False


def test_quantiles_by_group(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 9, 9)] + [("b", 2.0)] + [("c", None)], "g string, x double")
    got = {r["g"]: (r["n"], r["quantile"]) for r in O.quantile(df, "x", 0.5, ["g"]).collect()}
    assert got == {"a": (4, 7.0), "b": (1, 2.0)}
    assert O.value_at(df.where("g = 'c'"), "x", {"m": F.expr("n div 2")}).first().asDict() == {"n": 0, "m": None}


def test_record_file(spark, tmp_path):
    rows = [{"id": "a", "problem": "p", "cache_cost_usd": 0, "tiers": [{"tier": "s", "score": 1, "correct": True, "cost_usd": 0.5}]}, {"id": "b", "problem": "q", "shadow": True, "tiers": [{"tier": "s", "score": 0.5, "correct": True, "true_correct": False, "cost_usd": 1, "timed_out": True}]}]
    (tmp_path / "r.json").write_text(json.dumps(rows, indent=1))
    got = L.read_records(spark, f"file://{tmp_path}/r.json").orderBy("rec_idx").collect()
    assert [(r["rec_idx"], r["id"], r["shadow"], r["tiers"][0]["true_correct"], r["tiers"][0]["timed_out"]) for r in got] == [(0, "a", False, None, False), (1, "b", True, False, True)]
    (tmp_path / "bad.json").write_text('[{"id": 1, "tiers": 3')
    with pytest.raises(Exception):
        L.read_records(spark, f"file://{tmp_path}/bad.json").collect()


def test_problem_lines(spark):
    lines = spark.createDataFrame([(1, '{"id": "x", "problem": "a"}'), (2, "  "), (3, "// note"), (4, '{"problem": "b"}')], "line_no long, value string")
    assert [(r["id"], r["problem"]) for r in L.parse_problems(lines).orderBy("line_no" if False else "id").collect()] == [("p004", "b"), ("x", "a")]


def test_reference_tree(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "solution.go").write_text(f"package {name}")
    assert {r["id"]: r["source"] for r in L.read_tree(spark, str(tmp_path)).collect()} == {"one": "package one", "two": "package two"}
    (tmp_path / "x" / "one").mkdir(parents=True)
    (tmp_path / "x" / "one" / "solution.go").write_text("package again")
    with pytest.raises(Exception):
        L.read_tree(spark, str(tmp_path)).collect()


def test_streams_equal_batches(spark, tmp_path):
    records = B.records(spark, SF)
    records.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = V.running_risk(V.shadow_stream(stream, 0.5), [0.4, 0.3]).writeStream.outputMode("complete").format("memory").queryName("risk").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("risk").collect())) == sorted(map(tuple, V.running_risk(V.shadow_stream(records, 0.5), [0.4, 0.3]).collect()))


def test_failure_memory(spark, tmp_path):
    rows = [(1, s, f"h{s % 5}") for s in range(20)] + [(2, s, f"h{s}") for s in range(3)]
    spark.createDataFrame(rows, "problem long, seq long, hash string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("problem long, seq long, hash string").parquet(str(tmp_path / "in"))
    q = V.failure_memory(stream).writeStream.outputMode("append").format("memory").queryName("memory").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["problem"], r["seq"]) for r in spark.table("memory").collect()) == [(1, s) for s in range(5)] + [(2, s) for s in range(3)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs over a growing folder at one checkpoint: every row once."""
    for i in range(2):
        spark.range(i * 100, i * 100 + 100).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        got = V.to_table(V.shadow_stream(stream, 0.5, "id"), "resumed", at=f"file://{tmp_path}/out")
        want = V.shadow_stream(spark.range(i * 100 + 100), 0.5, "id")
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_failures_fall_out_of_a_memory_and_runs_go_on(spark, tmp_path):
    """A memory of three over two runs: the second run starts from the first one's state, and brings no batch twice."""
    runs = [[(1, s, h) for s, h in enumerate("abcdab")] + [(2, 0, "a")], [(1, s, h) for s, h in enumerate("cbeaz", 6)] + [(2, 6, "a"), (3, 9, "a")]]
    held, want = {}, set()
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, "problem long, seq long, hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("problem long, seq long, hash string").parquet(str(tmp_path / "in"))
        got = V.to_table(V.failure_memory(stream, most=3), "failures", at=f"file://{tmp_path}/out")
        for p, s, h in rows:
            memory = held.setdefault(p, [])
            if h not in memory:
                want.add((p, s, h))
                held[p] = [*memory, h][-3:]
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want), i
    assert (1, 4, "a") in want  # it fell out and came again
    again = V.to_table(V.failure_memory(spark.readStream.schema("problem long, seq long, hash string").parquet(str(tmp_path / "in")), most=3), "failures", at=f"file://{tmp_path}/out")
    assert again.count() == len(want)


def test_warm_cache_in_two_batches(spark, tmp_path):
    items = [(1, "sort a list of numbers"), (2, "sort a list of number"), (3, "entirely other"), (4, "sort a list of numbers"), (5, "ab"), (2, "sort a list of number"), (6, None)]
    at, inside = f"file://{tmp_path}/out", str(tmp_path / "in")
    for part in (items[:2], items[2:]):
        spark.createDataFrame(part, "id long, text string").coalesce(1).write.mode("append").parquet(inside)
        V.warm_cache(spark.readStream.schema("id long, text string").parquet(inside), at).awaitTermination()
    rows = spark.read.parquet(f"{at}/best").collect()
    best = {(r["batch"], r["id"]): r["best"] for r in rows}
    assert best[0, 1] == 0 and best[0, 2] > 0.9 and best[1, 4] == 1.0 and best[1, 5] == 0 and best[1, 3] < 0.2 and best[1, 6] == 0 and len(rows) == 7
    assert best[1, 2] > 0.9  # it meets the others, and is in the index once
    state = spark.read.format("statestore").option("stateVarName", "items").load(f"{at}/checkpoint")
    entries = [(r["key"]["g"], r["list_element"]["id"]) for r in state.collect()]
    assert len(entries) == len(set(entries)) and {i for _, i in entries} == {1, 2, 3, 4}


def test_keyed_store(spark, tmp_path):
    """Two layers, last write wins over commits, tombstones, merged buckets, a lost race and a crash before the switch."""
    from tierlab.sources.keyed import Conflict, KeyedStore, resume

    make = lambda: KeyedStore(spark, f"file://{tmp_path}/store", ["layer", "k"], "layer string, k long, v string", buckets=4, most_deltas=2)
    frame = lambda rows: spark.createDataFrame(rows, "layer string, k long, v string, at long")
    store = make()
    assert store.rows().count() == 0 and store.get(layer="a", k=1) == []
    want = {}
    commits = [[("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "z", 1), (None, None, "n", 1)], [("a", 1, "w", 0), ("a", 2, "q", 1)], [(None, None, "m", 1), ("b", 7, "u", 1)], [("a", i, f"v{i}", 1) for i in range(20)], [("b", 1, None, 1)]]
    for n, rows in enumerate(commits):
        assert store.upsert(frame(rows), ["at"]) == n + 1
        for layer, k, v, _ in sorted(rows, key=lambda r: r[3]):
            want[layer, k] = v
        assert {(r["layer"], r["k"]): r["v"] for r in store.rows().collect()} == want
    store.remove(frame([("a", 3, "", 1), ("zz", 9, "", 1)]))
    del want["a", 3]
    assert {(r["layer"], r["k"]): r["v"] for r in make().rows().collect()} == want
    assert store.get(layer="a", k=5)[0]["v"] == "v5" and store.get(layer="a", k=3) == [] and store.get(layer=None, k=None)[0]["v"] == "m"
    plan = store._merged(store._manifest(), [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "_bucket" in plan.split("PartitionFilters")[1][:200]
    other, lost = make(), make()
    lost._switch, switch = (lambda m: (_ for _ in ()).throw(OSError("lost before the switch"))), other._switch
    with pytest.raises(OSError):
        lost.upsert(frame([("a", 99, "no", 1)]))
    other._switch = lambda m: (store.upsert(frame([("a", 50, "first", 1)])), switch(m))
    with pytest.raises(Conflict):
        other.upsert(frame([("a", 51, "second", 1)]))
    want["a", 50] = "first"
    assert {(r["layer"], r["k"]): r["v"] for r in make().rows().collect()} == want
    store.clean()
    assert {(r["layer"], r["k"]): r["v"] for r in make().rows().collect()} == want
    solved = KeyedStore(spark, f"file://{tmp_path}/solved", ["id"], "id long, v long", buckets=2)
    seen = []

    def solve(rows, stop=None):
        if stop is not None and len(seen) == stop:
            raise InterruptedError
        seen.append(rows.count())
        return rows.select("id", (F.col("id") * 2).alias("v"))

    with pytest.raises(InterruptedError):
        resume(spark.range(100), solved, lambda rows: solve(rows, 2), parts=4)
    assert solved.rows().count() == sum(seen) < 100
    assert resume(spark.range(100), solved, solve, parts=4) == 2 and sum(seen) == 100
    assert {(r["id"], r["v"]) for r in solved.rows().collect()} == {(i, 2 * i) for i in range(100)}
    assert resume(spark.range(100), solved, solve, parts=4) == 0


def test_observation_files_and_certificates(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"id": "a", "tier": "s", "canonical_ran": True, "mutation_score": 1}, {"id": "b", "false_accept": True}]))
    got = L.read_array(spark, f"file://{tmp_path}/e.json", L.ESTIMATOR_FILE).orderBy("place").collect()
    assert [(r["id"], r["canonical_ran"], r["mutation_score"], r["false_accept"]) for r in got] == [("a", True, 1.0, None), ("b", None, None, True)]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "a", "seeds": 3, "levels": [{"level": "strict", "judged": 3, "false_accept": 1}]}]))
    from tierlab.operators import studies as D

    assert [tuple(r) for r in D.seeded_tally(L.read_array(spark, f"file://{tmp_path}/s.json", L.SEEDED_FILE)).collect()] == [("strict", 3, 1)]
    path = f"file://{tmp_path}/certificate"
    assert L.load_certificate(spark, path) is None
    L.save_certificate(spark.createDataFrame([(True, 0.1, [0.5, 1.0])], "valid boolean, alpha double, thresholds array<double>"), path)
    c = L.load_certificate(spark, path).first()
    assert (c["valid"], c["alpha"], c["thresholds"], c["p_value"]) == (True, 0.1, [0.5, 1.0], None)
    w = L.with_provenance(spark.range(3), "a sweep", alpha=0.1, seed=7).first()
    assert (w["note"], w["alpha"], w["seed"], [r["id"] for r in w["rows"]]) == ("a sweep", 0.1, 7, [0, 1, 2])


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_p_zero_reads_every_record_and_any_keys(spark, tmp_path):
    import math

    from tierlab.operators import policy as P
    from tierlab.plans.registry import QUERIES
    from tierlab.sources import bindings as B

    spark.range(500).select((F.col("id") * 7 + 1000).alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    seen = {}
    for r in P.observations(B.records(spark, str(tmp_path))).orderBy("rec_idx").collect():
        seen.setdefault(r["tier"], []).append(math.log1p(-min(r["score"], 0.999)))
    got = {r["tier"]: r["p_zero"] for r in QUERIES["p_zero"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({t: math.exp(sum(x[:20])) for t, x in seen.items()}, abs=2e-9)
    every = {r["tier"]: (r["n"], r["log_p_zero"]) for r in QUERIES["p_zero_all"](spark, str(tmp_path)).collect()}
    assert {t: n for t, (n, _) in every.items()} == dict.fromkeys(seen, 500)
    assert {t: x for t, (_, x) in every.items()} == pytest.approx({t: sum(x) for t, x in seen.items()}, abs=1e-5)


def test_smallest_draws_match_a_sort(spark):
    """Rounds of histograms, ties of the draw, cells of other sizes, and a bound that is the last row."""
    rows = spark.range(30000).selectExpr("id % 3 as cell", "id", "pmod(xxhash64(id), 1 << 48) as d").where("cell < 2 or id < 300")
    rows = rows.withColumn("d", F.when(F.col("cell") == 1, F.shiftright("d", 40)).otherwise(F.col("d")))  # one of 256 draws each
    by = {}
    for r in rows.collect():
        by.setdefault(r["cell"], []).append((r["d"], r["id"]))
    for k in (1, 57, 100):
        for total in (30000, 10):
            wanted = spark.createDataFrame([(0, k), (1, k), (2, min(k, len(by[2])))], "cell long, k long")
            got = {r["cell"]: (r["bound_draw"], r["bound_tie"]) for r in O.smallest(rows, ["cell"], "d", "id", wanted, total).collect()}
            assert got == {c: sorted(by[c])[min(k, len(by[c])) - 1] for c in by}


def test_first_drawn_matches_a_sort_for_even_and_uneven_draws(spark):
    import random

    rng = random.Random(5)
    for spread in (lambda: rng.randrange(1 << 48), lambda: rng.randrange(4), lambda: 7):
        data = [(c, i, spread()) for c, size in (("a", 900), ("b", 40), ("c", 1)) for i in range(size)]
        rows = spark.createDataFrame(data, "cell string, id long, d long")
        for ks in ({"a": 1, "b": 40, "c": 1}, {"a": 450, "b": 3}, {"a": 899}):
            sizes = {"a": 900, "b": 40, "c": 1}
            wanted = spark.createDataFrame([(c, k, sizes[c]) for c, k in ks.items()], "cell string, k long, n long")
            by = {c: sorted((d, i) for x, i, d in data if x == c) for c in ks}
            got = sorted((r["cell"], r["d"], r["id"]) for r in O.first_drawn(rows, ["cell"], "d", "id", wanted).collect())
            assert got == sorted((c, *at) for c, k in ks.items() for at in by[c][:k])
            bounds = {r["cell"]: (r["bound_draw"], r["bound_tie"]) for r in O.draw_bounds(rows, ["cell"], "d", "id", wanted).collect()}
            assert bounds == {c: by[c][k - 1] for c, k in ks.items()}


def test_sweep_of_no_records_has_no_rows(spark):
    assert W.absorption_sweep(B.records(spark, SF).limit(0), ["easy-first", "uniform"], [0.0, 0.5], 0.2, 0.1, [0.4, 0.3], [0.0, 0.5]).collect() == []


def test_adaptive_level_follows_a_plain_loop_and_drops_late_rows(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=rng.randrange(60 * part, 60 * part + 90)), part * 1000 + i, rng.choice([None, *(x / 20 for x in range(21))]), rng.choice([True, False, False, None])) for part in range(3) for i in range(60) for k in (1, 2)]
    late = (1, start - timedelta(hours=3), 9001, 1.0, True)
    dull = [(1, None, 9002, 0.9, False), (1, start, None, 0.9, False)]  # no time, no number
    end = (7, start + timedelta(days=9), 9003, 1.0, False)  # lets the watermark pass all others; waits itself
    schema, inside, at = "key long, ts timestamp, seq long, score double, wrong boolean", str(tmp_path / "in"), f"file://{tmp_path}/out"
    batches = [[r for r in rows if r[2] // 1000 == part] for part in range(3)]
    for batch in (batches[0], batches[1] + dull, [*batches[2], late], [end]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(inside)
        stream = spark.readStream.schema(schema).parquet(inside)
        got = V.to_table(V.adaptive_level(stream, 0.5, 0.2, 0.05, "2 hours"), "level", at=at).collect()
    want = []
    for k in (1, 2):
        tau = 0.5
        for _, _, seq, score, wrong in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            accepted = 1 - (score or 0.0) <= tau
            err = accepted and wrong is not False
            want.append((k, seq, tau, accepted, err))
            tau += 0.05 * (0.2 - err)
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r[4] for r in want) and any(not r[3] for r in want)


def test_adaptive_level_calls_the_store_by_lanes_not_by_rows():
    """A lane of 1,000 rows and 100 keys, one of them null: a few messages, and the levels of a plain loop."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def appendValue(self, value):  # noqa: N802
            calls.append("append")
            self.held = [*(self.held or []), value]

        put = update

        def clear(self):
            self.held = None

    class Handle:
        getValueState = getListState = lambda self, *a: State()

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

    class Now:
        getCurrentWatermarkInMs = lambda self: 899

    lane = V.AdaptiveLevel(0.5, 0.2, 0.05)
    lane.init(Handle())
    rows = pd.DataFrame({"at": range(999, -1, -1), "seq": range(1000), "key": [i % 100 for i in range(1000)], "none": [i % 100 == 0 for i in range(1000)], "oddity": [i * 7 % 10 / 10 for i in range(1000)], "wrong": [i % 3 == 0 for i in range(1000)]})
    assert list(lane.handleInputRows((0,), iter([rows]), Now())) == []
    (out,) = lane.handleExpiredTimer((0,), Now(), None)
    assert len(calls) < 12 and len(out) == 900 and out["key"].isna().sum() == 9 and list(lane.handleExpiredTimer((0,), Now(), None)) == []
    level, want = {}, []
    for r in rows[rows["at"] <= 899].sort_values("at").itertuples():
        tau = level.get(r.key, 0.5)
        err = r.oddity <= tau and r.wrong
        want.append((r.seq, tau, r.oddity <= tau, err))
        level[r.key] = tau + 0.05 * (0.2 - err)
    assert list(out[["seq", "tau", "accepted", "err"]].itertuples(index=False, name=None)) == want


def test_drawn_cells_are_summed_in_the_pass_that_finds_their_bounds(spark, monkeypatch):
    base = W.coded_base(P.usable(B.records(spark, SF)), 2)
    n, cells = base.count(), ["pattern", "rho", "seed"]
    want = {}
    for rho, seed in ((0.2, 1), (0.2, 2), (0.6, 1), (0.6, 2)):
        rows = sorted(base.withColumn("d", W.draw(f"draw-{seed}-{rho}-")).collect(), key=lambda r: (r["d"], r["rec_idx"]))[round(rho * n) :]
        want["uniform", rho, seed] = (len(rows), sum(r["t0_right"] for r in rows), sum(r["_x"]["_w0"] or 0 for r in rows))
    summed = lambda p: {tuple(r[:3]): tuple(r[3:]) for r in p.groupBy(*cells).agg(F.sum("_n"), F.sum("right"), F.sum("_w0")).collect()}
    uneven = lambda wanted, bits: O.expected(wanted, bits).withColumn("_low", F.lit(0).cast("long")).withColumn("_high", F.lit(0).cast("long"))
    with monkeypatch.context() as m:
        m.setattr(W, "draw_bounds", lambda *_: pytest.fail("rows were drawn twice"))
        assert summed(W.drawn_profiles(base, [0.2, 0.6], [1, 2], n, 2)[0]) == want
    monkeypatch.setattr(W, "expected", uneven)  # bounds aren't where they should be
    profiles, bounds = W.drawn_profiles(base, [0.2, 0.6], [1, 2], n, 2)
    assert summed(profiles) == want and W.drawn_left(base, [0.2, 0.6], [1, 2], bounds).count() == sum(x[0] for x in want.values())
