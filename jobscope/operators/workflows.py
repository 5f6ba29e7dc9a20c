"""Workflow steps, derived workflow state, dependency depth."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobscope.operators.search import Page, page
from jobscope.operators.shape import broadcast_if_small
from jobscope.schemas import SEARCH_LIMIT
from jobscope.session import cut_lineage, discard


def steps_with_jobs(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Steps with the state and times of their job; a step without a job keeps its row."""
    return steps.join(jobs.select("job_id", "type", "state", "started_at", "completed_at"), "job_id", "left").select(
        "workflow_id", "step_id", "depends_on", "job_id", "type", "state", "started_at", "completed_at"
    )


def workflow_states(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Step count and state per workflow: any failed step fails it, all completed complete it."""
    joined = steps.select("workflow_id", "job_id").join(jobs.select("job_id", "state"), "job_id", "left")
    counts = joined.groupBy("workflow_id").agg(
        F.count("*").alias("step_count"),
        F.count_if(F.col("state").isin("discarded", "cancelled")).alias("bad"),
        F.count_if(F.col("state") == "completed").alias("done"),
    )
    state = F.when(F.col("bad") > 0, "failed").when(F.col("done") == F.col("step_count"), "completed").otherwise("running")
    return counts.select("workflow_id", "step_count", state.alias("state"))


def workflow_list(states: DataFrame, state: str | None = None, limit: int = SEARCH_LIMIT) -> Page:
    if state:
        states = states.filter(F.col("state") == state)
    return page(states, ["workflow_id"], limit)


def _cut_counting_open(paths: DataFrame) -> tuple[DataFrame, int, int]:
    """Write the paths to the shared folder; also the number of rows and of unfinished rows, counted on the way."""
    seen = Observation()
    counted = paths.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("up").alias("open"))
    written = cut_lineage(counted, "depth")
    return written, seen.get["rows"], seen.get["open"]


def dependency_depth(edges: DataFrame) -> DataFrame:
    """Depth and root of every step when each step depends on at most one other.

    ``edges`` has (workflow_id, step_id, depends_on), null for a first step.  Paths are doubled: after
    round k a step knows its ancestor 2^k levels up, so a chain of n steps takes log2(n) joins.  Both
    join columns include the step, so a workflow of any size is spread over all tasks.  A dependency on
    an unknown step makes that name the root; steps on or behind a cycle get a null depth.
    """
    known = edges.select("workflow_id", F.col("step_id").alias("depends_on"), F.lit(True).alias("_known"))
    current = edges.join(known, ["workflow_id", "depends_on"], "left").select(
        "workflow_id",
        "step_id",
        F.when(F.col("_known"), F.col("depends_on")).alias("up"),
        F.when(F.col("_known"), 1).otherwise(F.when(F.col("depends_on").isNotNull(), 1).otherwise(0)).cast("bigint").alias("depth"),
        F.when(F.col("_known"), F.col("depends_on")).otherwise(F.coalesce("depends_on", "step_id")).alias("root"),
    )
    current, total, waiting = _cut_counting_open(current)
    rounds = 0
    while waiting and 2**rounds <= 2 * total:
        above = current.select(
            "workflow_id", F.col("step_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root")
        )
        # Steps whose path is complete need no join; the rest look up their ancestor's own path.
        open_steps = current.filter(F.col("up").isNotNull()).join(above, ["workflow_id", "up"]).select(
            "workflow_id", "step_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_root").alias("root")
        )
        before = current
        current, _, waiting = _cut_counting_open(current.filter(F.col("up").isNull()).unionByName(open_steps))
        discard(before)
        rounds += 1
    cyclic = F.col("up").isNotNull()
    return current.select(
        "workflow_id", "step_id", F.when(~cyclic, F.col("depth")).alias("depth"), F.when(~cyclic, F.col("root")).alias("root"), cyclic.alias("cyclic")
    )


#: A round that would join more pairs than this many times its rows places one level instead of doubling.
MOST_GROWTH = 8
#: Workflows of at most this many rows are placed in one task.
TASK_ROWS = 20_000


def dependency_levels(edges: DataFrame) -> DataFrame:
    """Longest path to every step of a general graph; ``edges`` has one row per (step, depends_on).

    Workflows of up to ``TASK_ROWS`` rows are dealt to tasks, which place the steps of each; larger ones are placed in
    rounds of joins.  Steps on or behind a cycle get a null level.  Dependencies on unknown steps are ignored, as are
    those of steps or workflows without a name; repeated rows count once.
    """
    key = ["workflow_id", "step_id"]
    rows = cut_lineage(edges.select(*key, "depends_on"), "edges")
    nameless = rows.where("workflow_id is null or step_id is null").select(*key).distinct()
    named = rows.where("workflow_id is not null and step_id is not null")
    large = cut_lineage(named.groupBy("workflow_id").agg(F.count("*").alias("_rows")).where(F.col("_rows") > TASK_ROWS), "large")
    some = not large.isEmpty()
    small = named.join(broadcast_if_small(large), "workflow_id", "left_anti") if some else named
    dealt = small.repartition("workflow_id").sortWithinPartitions("workflow_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    levels = dealt.mapInArrow(_place_sorted(), f"{kinds}, level int")
    levels = levels.unionByName(nameless.withColumn("level", F.lit(0)))
    if some:
        levels = levels.unionByName(_levels_by_rounds(named.join(broadcast_if_small(large), "workflow_id", "left_semi")))
    return levels


def _place_sorted():
    """Levels of the workflows whose rows follow each other."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def levels(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
            found = [(w, step, level) for w, rows in groupby(zip(*columns), itemgetter(0)) for step, level in _placed(rows).items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (*schema.types[:2], pa.int32()))], names=[*schema.names[:2], "level"])

        held: list[list] = [[], [], []]
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            held = [old + new.to_pylist() for old, new in zip(held, batch.columns)]
            # The last workflow may go on in the next batch.
            cut = bisect_left(held[0], True, key=lambda w, last=held[0][-1]: w == last)
            if cut:
                yield levels([c[:cut] for c in held], schema)
                held = [c[cut:] for c in held]
        if schema is not None:
            yield levels(held, schema)

    return place


def _placed(rows: Iterable[tuple]) -> dict:
    """The level of each step of one workflow, None on or behind a cycle."""
    needs: dict = {}
    for _, step, before in rows:
        needs.setdefault(step, set()).add(before)
    dependents, missing = defaultdict(list), {}
    for step, all_before in needs.items():
        known = [x for x in all_before if x in needs]
        missing[step] = len(known)
        for x in known:
            dependents[x].append(step)
    level = dict.fromkeys(needs, 0)
    ready = [step for step, n in missing.items() if not n]
    for step in ready:
        for x in dependents[step]:
            level[x] = max(level[x], level[step] + 1)
            missing[x] -= 1
            if not missing[x]:
                ready.append(x)
    return {step: None if missing[step] else x for step, x in level.items()}


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """Levels of workflows of any size.

    Jumps are pairs of steps with a path of exactly L dependencies between them; L doubles each round, and a level is
    the longest of its own so far and L more than that of a step jumped to.  So the number of rounds grows with the
    logarithm of the depth.  Where steps with many dependents and many dependencies would make pairs of all of them,
    a round places the steps whose dependencies are all placed, which is one level; such graphs are wide rather than
    deep.  Steps on or behind a cycle have jumps as long as their workflow has steps, and get a null level.
    """
    key, up = ["workflow_id", "step_id"], ["workflow_id", "depends_on"]
    steps = cut_lineage(edges.select(*key).distinct(), "steps")
    known = steps.withColumnRenamed("step_id", "depends_on")
    links = edges.filter(F.col("depends_on").isNotNull()).select(*key, "depends_on").distinct()
    links = cut_lineage(links.join(known, up, "left_semi"), "links")
    sizes = cut_lineage(steps.groupBy("workflow_id").agg(F.count("*").alias("_steps")), "sizes")
    levels = cut_lineage(steps.select(*key, F.lit(0).cast("bigint").alias("level"), F.lit(False).alias("placed"), F.lit(False).alias("cyclic")), "levels")
    jumps, length = cut_lineage(links, "jumps"), 1
    while not jumps.isEmpty():
        above = levels.select("workflow_id", F.col("step_id").alias("depends_on"), F.col("level").alias("_level"), F.col("placed").alias("_placed"))
        reach = jumps.join(above, up).groupBy(*key).agg((F.max("_level") + length).alias("_reach"))
        onward = jumps.groupBy(*key).agg(F.count("*").alias("_out"))
        inward = jumps.groupBy(*up).agg(F.count("*").alias("_in")).withColumnRenamed("depends_on", "step_id")
        pairs = onward.join(inward, key).agg(F.sum(F.col("_in") * F.col("_out"))).first()[0] or 0
        if pairs <= MOST_GROWTH * jumps.count():
            # A path as long as its workflow has steps runs in a cycle.
            round_ = jumps.join(broadcast_if_small(sizes), "workflow_id").where(F.col("_steps") <= length).select(*key).distinct()
            turning = cut_lineage(round_.withColumn("_turns", F.lit(True)), "turning")
            found = levels.join(reach, key, "left").join(turning, key, "left").select(
                *key, F.greatest("level", F.coalesce("_reach", "level")).alias("level"), "placed", (F.col("cyclic") | F.coalesce("_turns", F.lit(False))).alias("cyclic")
            )
            straight = jumps.join(turning, key, "left_anti")
            onto = straight.select("workflow_id", F.col("step_id").alias("depends_on"), F.col("depends_on").alias("_next"))
            further = straight.join(onto, up).select(*key, F.col("_next").alias("depends_on")).distinct()
            length *= 2
        else:
            turning = None
            open_ = links.join(levels.where("not placed").select(*key), key, "left_semi")
            ready = open_.join(above, up).groupBy(*key).agg(F.bool_and("_placed").alias("_ready"), (F.max("_level") + 1).alias("_reach"))
            found = levels.join(ready, key, "left").select(
                *key,
                F.when(~F.col("placed") & F.col("_ready"), F.col("_reach")).otherwise(F.col("level")).alias("level"),
                (F.col("placed") | F.coalesce("_ready", F.lit(True))).alias("placed"),
                "cyclic",
            )
            further = None
        before, levels = levels, cut_lineage(found, "levels")
        if further is None:
            # Placed steps have their level; what is left jumps among the others.
            if levels.where("placed").count() == before.where("placed").count():
                levels = levels.withColumn("cyclic", F.col("cyclic") | ~F.col("placed"))
                break
            further = jumps.join(levels.where("not placed").select(*key), key, "left_semi")
        old, jumps = jumps, cut_lineage(further, "jumps")
        for table in (old, before, *([turning] if turning is not None else [])):
            discard(table)
    return levels.select(*key, F.when(~F.col("cyclic"), F.col("level")).cast("int").alias("level"))
