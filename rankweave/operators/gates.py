"""Activation gates over a table of modules, and roll-ups of module audits.

A gate is flattened into clauses: each names a module or an external result and
the results it accepts; a module's clauses are joined by all_of or any_of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import design_status, result_status
from ..sources.shared import kept, release, shared_path


STATUS = ("met", "unmet", "unknown")


def _rule(operator: Column, met: Column, unmet: Column, unknown: Column) -> Column:
    """The place in STATUS of a gate all of whose clauses are settled."""
    any_of = F.when((met > 0) | (unmet + unknown == 0), 0).when(unmet > 0, 1).otherwise(2)
    return F.when(operator == "any_of", any_of).otherwise(F.when(unmet > 0, 1).when(unknown > 0, 2).otherwise(0))


def _through(passed: Column, status: Column) -> Column:
    return F.element_at(passed, status + 1)


def evaluated(modules: DataFrame, clauses: DataFrame, external: DataFrame, plan: str = "plan") -> DataFrame:
    """(plan, module_id, gate_status): met, unmet or unknown.

    modules: plan, module_id, result_status, design_status, operator (all_of or
    any_of).  clauses: plan, module_id, needs (a module) or gate (an external
    result), accepted (array).  external: plan, gate, result_status.  A module
    without clauses is met.  A clause on a module is met if its result is
    accepted, its design needs no resolution and its own gate is met; a missing
    module is unknown.  One met clause settles any_of, one unmet clause all_of.
    Modules that wait for each other in a cycle can't be met: those with an
    unmet clause, their own or passed on, are unmet, the others unknown.

    A clause that still waits carries where it points and what each status found
    there comes to here.  In every round only the modules settled last are
    joined with the waiting clauses, and a clause that points to a module with
    one waiting clause takes that clause's aim, so a chain of n modules takes
    about log2(n) rounds; as many rounds are made as it takes.
    """
    spark = modules.sparkSession
    m = modules.select(plan, "module_id", result_status(F.col("result_status")).alias("result"), design_status(F.col("design_status")).alias("design"), F.coalesce("operator", F.lit("all_of")).alias("operator"))
    needed = m.select(plan, F.col("module_id").alias("needs"), F.col("result").alias("n_result"), F.col("design").alias("n_design"))
    ext = external.select(plan, F.lower(F.trim("gate")).alias("gate"), result_status(F.col("result_status")).alias("x_result"))
    c = clauses.withColumn("gate", F.lower(F.trim("gate"))).join(needed, [plan, "needs"], "left").join(ext, [plan, "gate"], "left")
    accepts = lambda r: F.array_contains("accepted", F.col(r))
    on_module = F.col("needs").isNotNull()
    fixed = (
        F.when(~on_module, F.when(F.array_contains("accepted", F.coalesce("x_result", F.lit("not_run"))), 0).otherwise(1))
        .when(F.col("n_result").isNull(), 2)
        .when(~accepts("n_result"), 1)
        .when(F.col("n_design") == "needs_resolution", 1)
    )
    waiting = c.select(plan, "module_id", "needs", F.array(*map(F.lit, range(3))).alias("passed"), fixed.alias("found"))
    none = F.lit(0).cast("long")
    still_open = m.select(plan, "module_id", "operator", *[none.alias(s) for s in STATUS])

    path = shared_path(spark, "gates")
    n_round = 0
    while True:
        found = lambda s: F.count_if(F.col("found") == s)
        aim = F.max(F.when(F.col("found").isNull(), F.struct("needs", "passed")))
        sums = waiting.groupBy(plan, "module_id").agg(*[found(i).alias(f"n_{s}") for i, s in enumerate(STATUS)], F.count_if(F.col("found").isNull()).alias("n_open"), aim.alias("aim"))
        counts = [(F.col(s) + F.coalesce(f"n_{s}", none)).alias(s) for s in STATUS]
        now = still_open.join(sums, [plan, "module_id"], "left").select(plan, "module_id", "operator", *counts, F.coalesce("n_open", none).alias("n_open"), "aim")
        early = F.when((F.col("operator") == "any_of") & (F.col("met") > 0), 0).when((F.col("operator") != "any_of") & (F.col("unmet") > 0), 1)
        status = F.when(F.col("n_open") == 0, _rule(F.col("operator"), *map(F.col, STATUS))).otherwise(early)
        now = now.withColumn("status", status)
        now.write.parquet(f"{path}/round={n_round}")
        now = spark.read.schema(now.schema).parquet(f"{path}/round={n_round}")
        still_open = now.filter("status IS NULL")
        size = now.agg(F.count("status").alias("settled"), F.count(F.lit(1)).alias("all")).first()
        if size["settled"] == size["all"]:
            break
        settled = now.filter("status IS NOT NULL")
        left = waiting.filter("found IS NULL").join(still_open.select(plan, "module_id"), [plan, "module_id"], "left_semi")
        if not size["settled"] and n_round:  # only cycles are left, and what waits for them: an unmet clause is all that can still decide
            last = left.groupBy(plan, "module_id").agg(F.count_if(_through(F.col("passed"), F.lit(2)) == 1).alias("more"))
            settled = still_open.join(last, [plan, "module_id"]).filter("unmet + more > 0").withColumn("status", F.lit(1)).drop("more")
            n_round += 1
            settled.write.parquet(f"{path}/round={n_round}")
            settled = spark.read.schema(settled.schema).parquet(f"{path}/round={n_round}")
            if settled.isEmpty():
                break
            still_open = still_open.join(settled.select(plan, "module_id"), [plan, "module_id"], "left_anti")
            left = left.join(settled.select(plan, "module_id"), [plan, "module_id"], "left_anti")
        at = settled.select(plan, F.col("module_id").alias("needs"), F.col("status").alias("at"))
        after = lambda s: _rule(F.col("operator"), *[F.col(x) + (_through(F.col("aim.passed"), F.lit(s)) == i).cast("long") for i, x in enumerate(STATUS)])
        single = still_open.filter("n_open = 1").select(plan, F.col("module_id").alias("needs"), F.col("aim.needs").alias("further"), F.array(*[after(s) for s in range(3)]).alias("by"))
        aimed = left.join(single, [plan, "needs"], "left")
        passed = F.when(F.col("by").isNull(), F.col("passed")).otherwise(F.transform("by", lambda s: _through(F.col("passed"), s)))
        aimed = aimed.select(plan, "module_id", F.coalesce("further", "needs").alias("needs"), passed.alias("passed"))
        before, waiting = waiting, kept(aimed.join(at, [plan, "needs"], "left").select(plan, "module_id", "needs", "passed", _through(F.col("passed"), F.col("at")).alias("found")), "clauses")
        if n_round:  # the first clauses are the caller's
            release(before)
        still_open = still_open.select(plan, "module_id", "operator", *STATUS)
        n_round += 1
    done = spark.read.schema(now.schema).parquet(path).filter("status IS NOT NULL").select(plan, "module_id", "status")
    done = done.unionByName(still_open.select(plan, "module_id", F.lit(2).alias("status")))
    return done.select(plan, "module_id", F.element_at(F.array(*map(F.lit, STATUS)), F.col("status") + 1).alias("gate_status"))


def execution_status(gate: str = "gate_status", design: str = "design_status") -> Column:
    """ready_now if the gate is met and the design complete, else conditional_future."""
    return F.when((F.col(gate) == "met") & (F.col(design) == "execution_complete"), "ready_now").otherwise("conditional_future")


def one_per_role(modules: DataFrame, keys: list[str], role: str, score: str, order: str) -> DataFrame:
    """The most complete module of each role, the first of equals."""
    nth = F.row_number().over(Window.partitionBy(*keys, role).orderBy(F.desc(score), order))
    return modules.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def unique_ids(modules: DataFrame, keys: list[str], id_col: str, order: str) -> DataFrame:
    """Repeated ids of a plan renamed base.2, base.3, ... in order."""
    nth = F.row_number().over(Window.partitionBy(*keys, id_col).orderBy(order))
    return modules.withColumn(id_col, F.when(nth == 1, F.col(id_col)).otherwise(F.concat_ws(".", id_col, nth.cast("string"))))


def provenance_audit(parameters: DataFrame, key: str, value: str, source: str, ids: str) -> DataFrame:
    """(key, n, n_issues, status): parameters without a value, without a source, or cited without ids are issues."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    issue = F.when(blank(value), "missing_value").when(blank(source), "missing_source").when((F.col(source) == "literature") & (F.coalesce(F.size(ids), F.lit(0)) <= 0), "missing_reference")
    out = parameters.withColumn("_issue", issue).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("_issue").alias("n_issues"))
    return out.withColumn("status", F.when(F.col("n_issues") == 0, "complete").when(F.col("n_issues") < F.col("n"), "partial").otherwise("incomplete"))


def completeness(df: DataFrame, blocking: str, minor: str) -> DataFrame:
    """``df`` with design_status by its two issue lists: any blocking one needs resolution, minor ones leave a decision-complete design."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return df.withColumn("design_status", F.when(size(blocking) > 0, "needs_resolution").when(size(minor) > 0, "decision_complete").otherwise("execution_complete"))
