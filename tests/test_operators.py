import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.operators import contracts, lifecycle, reconcile, search, workflows


def contract(spark, items):
    rows = [(s, r, t, n, k, q, i) for i, (s, r, t, n, k, q) in enumerate(items)]
    return spark.createDataFrame(rows, "service string, role string, job_type string, arg_name string, arg_type string, required boolean, ord int")


def test_contract_pairs(spark, rows):
    args = contract(
        spark,
        [
            ("p1", "producer", "mail", "to", "string", True),
            ("p2", "producer", "mail", "to", "int", True),
            ("p3", "producer", "mail", "to", "int", True),
            ("c1", "consumer", "mail", "to", "string", True),
            ("c1", "consumer", "mail", "cc", "string", False),
            ("c2", "consumer", "mail", "body", "string", True),
            ("alone", "consumer", "other", "x", "", False),
        ],
    )
    assert rows(contracts.consumer_verdicts(args)) == [("mail", "c1", 1, 2), ("mail", "c2", 0, 3)]
    assert tuple(contracts.suite_summary(args).first()) == (2, 5)
    assert rows(contracts.orphans(args).select("service", "warning")) == [("alone", "no producer contract found for this job type")]
    pairs = {r.service: (r.passed, r.errors) for r in contracts.pairs_of(args, ["c1"]).collect()}
    assert pairs["p1↔c1"] == (True, [])
    assert pairs["p2↔c1"] == (False, ['arg "to" type mismatch: producer=int, consumer=string'])
    assert contracts.pairs_of(args, ["c2", "p1"]).count() == 4
    errors = rows(contracts.argument_errors(args))
    assert ("mail", "body", "missing", None, "string", 3) in errors and ("mail", "to", "type", "int", "string", 2) in errors and len(errors) == 2


def plain_contracts(args):
    """Every pair of services, argument by argument."""
    sides = {"producer": {}, "consumer": {}}
    for service, role, job, name, kind, required in args:
        held = sides[role].setdefault((job, service), {})
        if name is not None:
            held[name] = (kind, required)
    verdicts, errors = {}, Counter()
    for (job, c), wants in sides["consumer"].items():
        given = [g for (j, _), g in sides["producer"].items() if j == job]
        failed = 0
        for g in given:
            bad = [(n, "missing", None, k) for n, (k, r) in wants.items() if n not in g and r]
            bad += [(n, "type", g[n][0], k) for n, (k, _) in wants.items() if n in g and k and g[n][0] != k]
            failed += bool(bad)
            errors.update((job, *b) for b in bad)
        if given:
            verdicts[job, c] = (len(given) - failed, failed)
    return verdicts, errors


@pytest.mark.parametrize("places", [16384, 7])
def test_contracts_equal_all_pairs(spark, monkeypatch, places):
    """Many lists of one job type, in one block and in many; types that are null or empty, contracts without arguments."""
    monkeypatch.setattr(contracts, "PLACES_PER_PART", places)
    rnd = random.Random(places)
    args = []
    for n in range(160):
        role = rnd.choice(["producer", "consumer"])
        job = rnd.choice(["big", "big", "big", "small", f"only-{role}"])
        names = rnd.sample("abcdef", rnd.choice([0, 1, 2, 3, 6]))
        args += [(f"s{n}", role, job, x, rnd.choice(["int", "int", "int", "string", "", None]), rnd.random() < 0.4) for x in names] or [(f"s{n}", role, job, None, None, None)]
    verdicts, errors = plain_contracts(args)
    df = contract(spark, args)
    assert {(r.job_type, r.consumer): (r.passed, r.failed) for r in contracts.consumer_verdicts(df).collect()} == verdicts
    assert Counter({tuple(r)[:5]: r.pairs for r in contracts.argument_errors(df).collect()}) == errors
    alone = {(s, r, j) for s, r, j, *_ in args if j.startswith("only-")}
    assert tuple(contracts.suite_summary(df).first()) == (sum(p for p, _ in verdicts.values()) + len(alone), sum(f for _, f in verdicts.values()))
    some = {r.service: r.passed for r in contracts.pairs_of(df, [f"s{n}" for n in range(20)]).collect()}
    assert sum(some.values()) > 0 and len(some) < sum(p + f for p, f in verdicts.values())


def test_contracts_of_a_crowded_job_type(spark):
    """10,000 distinct lists a side, 10^8 pairs: counted without a row per pair, equal to sums over bit masks."""
    number = spark.range(10000).withColumnRenamed("id", "n")
    # List n has the arguments of its bits; consumers ask for two of them.
    produced = number.select(F.concat(F.lit("p"), "n").alias("service"), F.lit("producer").alias("role"), "n", F.explode(F.array(*[F.struct(F.lit(f"b{i}").alias("arg_name"), F.shiftright("n", i).bitwiseAND(1).alias("bit")) for i in range(14)])).alias("a")).where("a.bit = 1")
    produced = produced.select("service", "role", F.col("a.arg_name"), F.lit("int").alias("arg_type"), F.lit(True).alias("required"))
    wanted = number.select(F.concat(F.lit("c"), "n").alias("service"), F.lit("consumer").alias("role"), F.explode(F.array(F.concat(F.lit("b"), F.col("n") % 14), F.concat(F.lit("b"), F.floor(F.col("n") / 14) % 14), F.concat(F.lit("own"), "n"))).alias("arg_name"))
    wanted = wanted.select("service", "role", "arg_name", F.lit("int").alias("arg_type"), (~F.col("arg_name").startswith("own")).alias("required"))
    args = produced.unionByName(wanted).select("service", "role", F.lit("crowd").alias("job_type"), "arg_name", "arg_type", "required", F.lit(1).alias("ord"))
    masks = np.arange(1, 10000)
    want = [int(np.sum((masks >> (n % 14) & 1) & (masks >> (n // 14 % 14) & 1))) for n in range(10000)]
    assert tuple(contracts.suite_summary(args).first()) == (sum(want), 9999 * 10000 - sum(want))
    got = {r.consumer: r.passed for r in contracts.consumer_verdicts(args).collect()}
    assert all(got[f"c{n}"] == want[n] for n in range(10000))


def test_last_declaration_of_an_argument_wins(spark):
    args = contract(spark, [("p", "producer", "t", "a", "int", True), ("p", "producer", "t", "a", "string", True), ("c", "consumer", "t", "a", "string", True)])
    assert tuple(contracts.suite_summary(args).first()) == (1, 0)


def test_depth_of_chains_roots_and_cycles(spark, rows):
    chain = [("w", f"s{i}", f"s{i - 1}" if i else None) for i in range(40)]
    odd = [("w", "x", "ghost"), ("w", "y", "x"), ("c", "a", "b"), ("c", "b", "a"), ("c", "d", "a")]
    edges = spark.createDataFrame(chain + odd, "workflow_id string, step_id string, depends_on string")
    got = {(r.workflow_id, r.step_id): (r.depth, r.root, r.cyclic) for r in workflows.dependency_depth(edges).collect()}
    assert all(got["w", f"s{i}"] == (i, "s0", False) for i in range(40))
    assert got["w", "x"] == (1, "ghost", False) and got["w", "y"] == (2, "ghost", False)
    assert all(got["c", s] == (None, None, True) for s in "abd")


def plain_levels(edges):
    """Steps are placed when all their known dependencies are."""
    steps = {(w, s) for w, s, _ in edges}
    needs = {x: {(w, d) for w, s, d in edges if (w, s) == x and (w, d) in steps} for x in steps}
    placed = {}
    while True:
        ready = [x for x in steps - placed.keys() if needs[x] <= placed.keys()]
        if not ready:
            return {x: placed.get(x) for x in steps}
        placed |= {x: max((placed[d] + 1 for d in needs[x]), default=0) for x in ready}


GRAPH = "workflow_id string, step_id string, depends_on string"


def test_levels_of_a_general_graph(spark):
    edges = [("w", "a", None), ("w", "b", "a"), ("w", "c", "a"), ("w", "d", "b"), ("w", "d", "a"), ("w", "e", "d"), ("w", "e", "ghost"), ("w", "p", "q"), ("w", "q", "p"), ("w", "r", "q"), ("w", "r", "a"), ("w", "z", "z")]
    df = spark.createDataFrame(edges + edges[:3], GRAPH)
    got = {r.step_id: r.level for r in workflows.dependency_levels(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "p": None, "q": None, "r": None, "z": None}
    assert workflows.dependency_levels(df.limit(0)).count() == 0


@pytest.mark.parametrize("growth", [0, 8, 10**9])
def test_levels_equal_placing_step_by_step(spark, monkeypatch, growth):
    """Sparse, dense and cyclic graphs of different sizes at once, by doubling, by placing levels and by both."""
    monkeypatch.setattr(workflows, "MOST_GROWTH", growth)
    rnd = random.Random(growth)
    edges = []
    for w, (n, many, back) in enumerate([(1, 0, 0), (12, 2, 0), (25, 4, 0), (9, 2, 0.2), (18, 1, 0.05), (2, 1, 1)]):
        for s in range(n):
            edges.append((f"w{w}", f"s{s}", None))
            edges += [(f"w{w}", f"s{s}", f"s{rnd.randrange(s)}") for _ in range(rnd.randint(0, many)) if s]
            edges += [(f"w{w}", f"s{s}", f"s{rnd.randrange(n)}")] * (rnd.random() < back)
    got = {(r.workflow_id, r.step_id): r.level for r in workflows.dependency_levels(spark.createDataFrame(edges, GRAPH)).collect()}
    assert got == plain_levels(edges) and None in got.values()


def count_rounds(monkeypatch):
    names = []
    write = workflows.cut_lineage
    monkeypatch.setattr(workflows, "cut_lineage", lambda df, name: names.append(name) or write(df, name))
    return names


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    names = count_rounds(monkeypatch)
    ladder = [("w", f"{side}{i}", f"{other}{i - 1}" if i else None) for i in range(100) for side in "ab" for other in "ab"]
    got = {r.step_id: r.level for r in workflows.dependency_levels(spark.createDataFrame(ladder, GRAPH)).collect()}
    assert got == {f"{side}{i}": i for i in range(100) for side in "ab"}
    assert names.count("jumps") - 1 <= 8


def test_hubs_are_not_made_into_pairs(spark, monkeypatch):
    """A step with 3,000 dependencies and 3,000 dependents: three levels are placed one by one."""
    names = count_rounds(monkeypatch)
    hub = [("w", f"a{i}", None) for i in range(3000)] + [("w", "hub", f"a{i}") for i in range(3000)] + [("w", f"b{i}", "hub") for i in range(3000)]
    got = {r.step_id: r.level for r in workflows.dependency_levels(spark.createDataFrame(hub, GRAPH)).collect()}
    assert got == {f"a{i}": 0 for i in range(3000)} | {"hub": 1} | {f"b{i}": 2 for i in range(3000)}
    assert names.count("jumps") - 1 <= 4


@pytest.mark.parametrize("growth", [0, 8, 10**9])
def test_levels_of_large_workflows(spark, monkeypatch, growth):
    """The same graphs, all but the smallest by rounds."""
    monkeypatch.setattr(workflows, "TASK_ROWS", 10)
    test_levels_equal_placing_step_by_step(spark, monkeypatch, growth)


@pytest.mark.parametrize("rounds", [test_rounds_grow_with_the_logarithm_of_the_depth, test_hubs_are_not_made_into_pairs])
def test_rounds_of_large_workflows(spark, monkeypatch, rounds):
    monkeypatch.setattr(workflows, "TASK_ROWS", 0)
    rounds(spark, monkeypatch)


def test_small_workflows_need_no_rounds(spark, monkeypatch):
    """Workflows over several batches of a task; steps without a name depend on nothing."""
    monkeypatch.setattr(workflows, "TASK_ROWS", 60)
    names = count_rounds(monkeypatch)
    edges = [(f"w{w}", f"s{s}", f"s{s - 1}" if s else None) for w in range(40) for s in range(1 + w)]
    lost = [(None, "a", "b"), (None, "b", None), ("w3", None, "s1")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.workflow_id, r.step_id): r.level for r in workflows.dependency_levels(spark.createDataFrame(edges + edges[:99] + lost, GRAPH)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(w, s): int(s[1:]) for w, s, _ in edges} | {(None, "a"): 0, (None, "b"): 0, ("w3", None): 0}
    assert "jumps" not in names


@pytest.fixture
def jobs(spark):
    at = dt.datetime(2024, 1, 1)
    states = ["available", "active", "completed", "discarded", "cancelled", "retryable"]
    rows = [(f"j{i}", "t", "q" if i % 2 else "r", s, 1, "[]", at + dt.timedelta(days=i), None) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "job_id string, type string, queue string, state string, priority int, args_json string, created_at timestamp_ntz, completed_at timestamp_ntz")


def test_bulk_needs_a_choice_and_counts_failures(spark, jobs):
    with pytest.raises(ValueError):
        lifecycle.bulk_transition(jobs, "cancel")
    ids = spark.createDataFrame([("j0",), ("j2",), ("nope",), ("j0",)], "job_id string")
    result = lifecycle.bulk_transition(jobs, "cancel", ids=ids)
    assert tuple(result.counts.first()) == (1, 2)
    assert result.snapshot.count() == 6 and result.snapshot.filter("state = 'cancelled'").count() == 2
    assert lifecycle.bulk_transition(jobs, "delete", state="completed").snapshot.count() == 5


def test_purge_age(jobs):
    as_of = dt.datetime(2024, 1, 10)
    result = lifecycle.purge(jobs, as_of, states=["completed", "discarded"], older_than="7d")
    assert [r.job_id for r in result.deleted.collect()] == ["j2"] or result.deleted.count() == 0
    assert result.kept.count() + result.deleted.count() == 6
    assert lifecycle.purge(jobs, as_of).deleted_count().first()[0] == 1


def test_replay_and_priority(spark, jobs):
    ids = spark.createDataFrame([("j3",), ("j4",)], "job_id string")
    new = lifecycle.replay(jobs, ids, queue="low", priority=9)
    assert {(r.queue, r.priority, r.state) for r in new.collect()} == {("low", 9, "available")}
    assert new.filter(F.col("job_id") == F.col("replayed_from")).count() == 0
    updates = spark.createDataFrame([("j0", 7), ("j1", -1), ("j2", 300)], "job_id string, new_priority int")
    patched, rejected = lifecycle.apply_priority(jobs, updates)
    assert patched.filter("priority = 7").count() == 1 and rejected.count() == 2


def test_search_total(jobs):
    got = search.search_jobs(jobs, queue="r", limit=2).with_total().collect()
    assert [r.job_id for r in got] == ["j4", "j2"] and {r.total for r in got} == {3}


def test_status_shows_only_present_columns(spark, jobs):
    ids = spark.createDataFrame([("j1",)], "job_id string")
    assert "progress" not in search.job_status(jobs, ids).columns
    with_progress = jobs.withColumn("progress", F.lit(0.5))
    assert search.job_status(with_progress, ids).first().progress == "50%"


def test_reconcile_with_repeated_ids(spark, rows):
    schema = "job_id string, type string, queue string, args_json string"
    a = spark.createDataFrame([("1", "t", "q", "[]"), ("2", "t", "q", "[]"), ("2", "t", "q", "[1]"), ("3", "t", "q", "[]")], schema)
    b = spark.createDataFrame([("1", "t", "q", "[]"), ("2", "t", "q", "[1]"), ("2", "t", "q", "[]"), ("4", "t", "q", "[]")], schema)
    assert rows(reconcile.reconcile(a, b)) == [("1", "matched"), ("2", "matched"), ("3", "missing"), ("4", "extra")]
    assert rows(reconcile.reconcile(a, b.withColumn("queue", F.lit("z"))))[:2] == [("1", "changed"), ("2", "changed")]


def test_functions_travel_without_the_package(tmp_path):
    """What tasks run can be loaded where this package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from jobscope.operators import ordered

    (tmp_path / "f").write_bytes(cloudpickle.dumps(ordered._keep_chain(5)))
    code = "import pickle; f = pickle.load(open('f', 'rb')); assert list(f(iter([]))) == []; import importlib.util as u; assert u.find_spec('jobscope') is None"
    subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, check=True)
