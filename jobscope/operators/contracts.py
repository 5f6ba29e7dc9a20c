"""Producer and consumer contracts: cross validation, orphans, payload checks.

A contract is identified by (service, role, job_type).  Every producer of a job type is checked against every
consumer of it without a row per pair: producers have places in words of 64 bits, an index holds the words of those
that provide an argument with a type, and a consumer list combines the words of its requirements.  Counts of
producers come out.  ``pairs_of`` lists the service pairs of chosen services.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions import arg_type, json_kind
from jobscope.operators.shape import broadcast_if_small, measured
from jobscope.operators.shape import once

KEY = ["service", "role", "job_type"]
#: Producers of a job type that are numbered together, about; a word holds 64 of them.
PLACES_PER_PART = 16384
WORD = 64


def resolve_args(contract_args: DataFrame) -> DataFrame:
    """One row per contract and argument name; the last declaration (largest ``ord``) wins."""
    last = F.max_by(F.struct("arg_type", "required"), F.col("ord"))
    return contract_args.groupBy(*KEY, "arg_name").agg(last.alias("a")).select(*KEY, "arg_name", "a.arg_type", "a.required")


def argument_lists(contract_args: DataFrame) -> DataFrame:
    """One row per contract with its arguments sorted by name and a digest of the list.

    A row with a null argument name says that a contract exists; a contract with no other row has an empty list.

    Duplicate declarations are folded before the list is built, so it is as long as the contract has names.
    A consumer's list includes the required flags; for a producer only names and types matter.
    """
    required = F.when(F.col("role") == "consumer", F.col("required"))
    item = F.struct("arg_name", "arg_type", required.alias("required"))
    named = F.when(F.col("arg_name").isNotNull(), item)
    lists = resolve_args(contract_args).groupBy(*KEY).agg(F.array_sort(F.collect_list(named)).alias("args"))
    return lists.withColumn("signature", F.md5(F.to_json("args")))


def _problems(consumer_args: Column, producer_args: Column) -> Column:
    """Arguments that break the pair: a required one is missing, or both declare it with different types."""
    provided = F.map_from_entries(F.transform(producer_args, lambda a: F.struct(a["arg_name"], a["arg_type"])))

    def problem(a: Column) -> Column:
        given = provided[a["arg_name"]]
        known = F.map_contains_key(provided, a["arg_name"])
        kind = F.when(~known & a["required"], "missing").when(
            known & (F.coalesce(a["arg_type"], F.lit("")) != "") & ~given.eqNullSafe(a["arg_type"]), "type"
        )
        return F.struct(a["arg_name"].alias("arg_name"), kind.alias("problem"), given.alias("producer_type"), a["arg_type"].alias("consumer_type"))

    return F.filter(F.transform(consumer_args, problem), lambda p: p["problem"].isNotNull())


def _placed(lists: DataFrame) -> DataFrame:
    """Producers with a block, which is a word, and their bit in it; a job type with many is dealt over several parts."""
    producers = lists.filter(F.col("role") == "producer").select("job_type", "service", "args")
    sizes = producers.groupBy("job_type").agg(F.ceil(F.count("*") / PLACES_PER_PART).alias("parts"))
    dealt = producers.join(broadcast_if_small(measured(sizes)), "job_type").withColumn("part", F.pmod(F.xxhash64("service"), F.col("parts")))
    number = F.row_number().over(Window.partitionBy("job_type", "part").orderBy("service")) - 1
    dealt = dealt.withColumn("number", number)
    block = F.col("part") * (1 << 20) + F.floor(F.col("number") / WORD)
    bit = F.expr(f"shiftleft(1L, number % {WORD})")
    return dealt.select("job_type", block.alias("block"), bit.alias("bit"), "args")


def _failing(lists: DataFrame, consumers: DataFrame) -> DataFrame:
    """(job_type, signature, failed): how many producers fail against each distinct consumer list, where any does.

    The producers that provide every required argument are the intersection of the words of those that provide
    each; those with a wrong type are a union of words.  The ones that pass are in the first and not in the second.
    """
    placed = measured(_placed(lists))
    each = placed.select("job_type", "block", "bit", F.inline("args")).select("job_type", "block", "bit", "arg_name", F.col("arg_type").alias("given"))
    keys = ["job_type", "arg_name", "block"]
    provided = measured(each.groupBy(*keys, "given").agg(F.bit_or("bit").alias("who")))
    present = provided.groupBy(*keys).agg(F.bit_or("who").alias("who"))
    total = placed.groupBy("job_type").agg(F.count("*").alias("total"))

    needs = consumers.select("job_type", "signature", F.inline("args"))
    required = needs.where("required").select("job_type", "signature", "arg_name")
    typed = needs.where("coalesce(arg_type, '') <> ''").select("job_type", "signature", "arg_name", "arg_type")
    kinds = typed.select("job_type", "arg_name", "arg_type").distinct()
    wrong = kinds.join(provided, ["job_type", "arg_name"]).where(~F.col("given").eqNullSafe(F.col("arg_type")))
    wrong = wrong.groupBy(*keys, "arg_type").agg(F.bit_or("who").alias("who"))

    nothing = F.lit(None).cast("bigint")
    have = required.join(present, ["job_type", "arg_name"]).select("job_type", "signature", "block", F.col("who").alias("have"), nothing.alias("bad"))
    bad = typed.join(wrong, ["job_type", "arg_name", "arg_type"]).select("job_type", "signature", "block", nothing.alias("have"), F.col("who").alias("bad"))
    met = have.unionByName(bad).groupBy("job_type", "signature", "block").agg(F.count("have").alias("met"), F.bit_and("have").alias("all"), F.bit_or("bad").alias("bad"))
    wrong_ones = F.coalesce("bad", F.lit(0).cast("bigint"))
    fit = F.coalesce(F.bit_count(F.col("all").bitwiseAND(F.bitwise_not(wrong_ones))), F.lit(0))
    either = met.select("job_type", "signature", "met", F.bit_count(wrong_ones).alias("bad"), fit.alias("fit"))
    blocks = either.groupBy("job_type", "signature", "met").agg(F.sum("bad").alias("bad"), F.sum("fit").alias("fit"))
    count = F.size(F.filter("args", lambda a: F.coalesce(a["required"], F.lit(False))))
    full = consumers.select("job_type", "signature", count.alias("needed")).join(broadcast_if_small(measured(total)), "job_type")
    # Without a required argument all producers fit that are not bad; otherwise those of the blocks where every argument is met.
    sums = blocks.groupBy("job_type", "signature").agg(F.sum("bad").alias("bad"), F.collect_list(F.struct("met", "fit")).alias("fits"))
    joined = full.join(sums, ["job_type", "signature"], "left")
    fits = F.filter("fits", lambda f: f["met"] == F.col("needed"))
    passed = F.when(F.col("needed") == 0, F.col("total") - F.coalesce("bad", F.lit(0))).otherwise(
        F.coalesce(F.aggregate(fits, F.lit(0).cast("bigint"), lambda a, f: a + f["fit"]), F.lit(0))
    )
    return joined.select("job_type", "signature", passed.alias("passed"), (F.col("total") - passed).alias("failed"))


def list_verdicts(contract_args: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """One row per job type and distinct consumer list: its consumers, and the producers that pass and fail."""
    lists = measured(argument_lists(contract_args)) if lists is None else lists
    side = lists.filter(F.col("role") == "consumer").groupBy("job_type", "signature")
    consumers = measured(side.agg(F.first("args").alias("args"), F.count("*").alias("consumers")))
    return consumers.select("job_type", "signature", "consumers").join(_failing(lists, consumers), ["job_type", "signature"])


def consumer_verdicts(contract_args: DataFrame) -> DataFrame:
    """Per job type and consumer: how many producers pass and how many fail against it."""
    lists = measured(argument_lists(contract_args))
    consumers = lists.filter(F.col("role") == "consumer").select("job_type", F.col("service").alias("consumer"), "signature")
    found = list_verdicts(contract_args, lists).drop("consumers")
    return consumers.join(found, ["job_type", "signature"]).select("job_type", "consumer", "passed", "failed")


def argument_errors(contract_args: DataFrame) -> DataFrame:
    """Per job type and consumer argument: how many service pairs fail on it, and how.

    A pair fails on an argument by what each side says of it alone, so the services that say the same are counted
    first, and their numbers multiplied.
    """
    args = measured(resolve_args(contract_args))
    name = ["job_type", "arg_name"]
    named = args.where("arg_name is not null")
    producers = named.where("role = 'producer'").groupBy(*name, F.col("arg_type").alias("producer_type")).agg(F.count("*").alias("p"))
    producers = measured(producers)
    consumers = named.where("role = 'consumer'").groupBy(*name, F.col("arg_type").alias("consumer_type"), "required").agg(F.count("*").alias("c"))
    consumers = measured(consumers)
    total = args.where("role = 'producer'").select("job_type", "service").distinct().groupBy("job_type").agg(F.count("*").alias("total"))
    have = producers.groupBy(*name).agg(F.sum("p").alias("have"))
    lacking = F.col("total") - F.coalesce("have", F.lit(0))
    missing = consumers.where("required").join(broadcast_if_small(measured(total)), "job_type").join(have, name, "left").where(lacking > 0)
    missing = missing.select(*name, F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("producer_type"), "consumer_type", (F.col("c") * lacking).alias("pairs"))
    differ = (F.coalesce("consumer_type", F.lit("")) != "") & ~F.col("producer_type").eqNullSafe(F.col("consumer_type"))
    wrong = consumers.join(producers, name).where(differ)
    wrong = wrong.select(*name, F.lit("type").alias("problem"), "producer_type", "consumer_type", (F.col("c") * F.col("p")).alias("pairs"))
    return missing.unionByName(wrong).groupBy(*name, "problem", "producer_type", "consumer_type").agg(F.sum("pairs").alias("pairs"))


def pairs_of(contract_args: DataFrame, services: Sequence[str]) -> DataFrame:
    """All pairs in which one of ``services`` takes part, with the messages a user reads."""
    lists = measured(argument_lists(contract_args))
    producers = lists.filter(F.col("role") == "producer").select(F.col("service").alias("producer"), "job_type", F.col("args").alias("producer_args"))
    consumers = lists.filter(F.col("role") == "consumer").select(F.col("service").alias("consumer"), "job_type", F.col("args").alias("consumer_args"))
    chosen_p = producers.filter(F.col("producer").isin(list(services)))
    chosen_c = consumers.filter(F.col("consumer").isin(list(services)))
    pairs = chosen_p.join(consumers, "job_type").unionByName(producers.join(chosen_c, "job_type")).distinct()

    def message(p: Column) -> Column:
        name = F.concat(F.lit('"'), p["arg_name"], F.lit('"'))
        return F.when(
            p["problem"] == "missing",
            F.concat(F.lit("consumer "), F.col("consumer"), F.lit(" expects required arg "), name, F.lit(" but producer "), F.col("producer"), F.lit(" doesn't provide it")),
        ).otherwise(F.concat(F.lit("arg "), name, F.lit(" type mismatch: producer="), p["producer_type"], F.lit(", consumer="), p["consumer_type"]))

    pairs = once(pairs, problems=_problems(F.col("consumer_args"), F.col("producer_args")))
    return pairs.select(
        F.concat(F.col("producer"), F.lit("↔"), F.col("consumer")).alias("service"),
        F.lit("cross").alias("role"),
        "job_type",
        (F.size("problems") == 0).alias("passed"),
        F.transform("problems", message).alias("errors"),
    )


def orphans(contract_args: DataFrame) -> DataFrame:
    """Contracts whose job type nobody declares on the other side; they pass with a warning."""
    contracts = contract_args.select(*KEY).distinct()
    found = []
    for role, other in (("producer", "consumer"), ("consumer", "producer")):
        opposite = contracts.filter(F.col("role") == other).select("job_type").distinct()
        alone = contracts.filter(F.col("role") == role).join(opposite, "job_type", "left_anti")
        found.append(alone.select(*KEY, F.lit(True).alias("passed"), F.lit(f"no {other} contract found for this job type").alias("warning")))
    return found[0].unionByName(found[1])


def suite_summary(contract_args: DataFrame) -> DataFrame:
    """Passed and failed results of the whole suite: service pairs plus orphans."""
    lists = measured(argument_lists(contract_args))
    verdicts = list_verdicts(contract_args, lists)
    checked = verdicts.select(
        F.explode(F.array(*[F.struct(F.lit(ok).alias("passed"), (F.col("consumers") * F.col(c)).alias("n")) for ok, c in ((True, "passed"), (False, "failed"))])).alias("v")
    ).select("v.passed", "v.n")
    sides = lists.groupBy("job_type").agg(F.count_if(F.col("role") == "producer").alias("p"), F.count_if(F.col("role") == "consumer").alias("c"))
    alone = sides.where("p = 0 or c = 0").select(F.lit(True).alias("passed"), (F.col("p") + F.col("c")).alias("n"))
    zero = F.lit(0).cast("bigint")
    return checked.unionByName(alone).agg(
        F.coalesce(F.sum(F.when(F.col("passed"), F.col("n"))), zero).alias("passed"),
        F.coalesce(F.sum(F.when(~F.col("passed"), F.col("n"))), zero).alias("failed"),
    )


def check_payloads(jobs: DataFrame, contract: DataFrame) -> DataFrame:
    """Jobs whose arguments do not fit the contract of their type, one row per bad argument.

    ``contract`` has one row per (job_type, position, arg_name, arg_type, required) - one contract per job
    type.  It is folded to one row per type, so each job is looked at once and never multiplied.
    """
    item = F.struct("position", "arg_name", arg_type("arg_type").alias("arg_type"), "required")
    per_type = contract.groupBy(F.col("job_type").alias("type")).agg(F.array_sort(F.collect_list(item)).alias("expected"))
    joined = jobs.select("job_id", "type", "args_json").join(broadcast_if_small(measured(per_type)), "type")
    parsed = once(joined, args=F.try_variant_get(F.try_parse_json("args_json"), F.lit("$"), "array<variant>"))
    each = parsed.select("job_id", "type", "args", F.inline("expected"))
    each = once(each, kind=json_kind(F.get("args", F.col("position").cast("int"))))
    kind = F.col("kind")
    fits = (
        F.col("arg_type").isin("any")
        | (kind == F.col("arg_type"))
        | ((F.col("arg_type") == "float") & kind.isin("number", "int"))
    )
    found = F.coalesce(kind, F.lit("missing"))
    wrong = F.when(kind.isNull() | (kind == "null"), F.col("required")).otherwise(~fits)
    return each.filter(wrong).select("job_id", "type", "position", "arg_name", "arg_type", found.alias("found"))
