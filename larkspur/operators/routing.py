"""Routing of work to models by policy tables, and the cascade of deciders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.tables import held


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with usd: the prices of the call's alias, or of the run's model where the alias isn't known.

    prices (model, price_in, price_out) is a policy table of a few rows; Spark broadcasts it below its own threshold.
    """
    own = prices.select(F.col("model").alias("alias"), F.struct("price_in", "price_out").alias("p1"))
    run = prices.select(F.col("model").alias("run_model"), F.struct("price_in", "price_out").alias("p2"))
    found = calls.join(own, "alias", "left").join(run, "run_model", "left").withColumn("p", F.coalesce("p1", "p2"))
    usd = (F.col("tokens_in") * F.col("p.price_in") + F.col("tokens_out") * F.col("p.price_out")) / 1e6
    return found.withColumn("usd", F.round(usd, 9)).drop("p", "p1", "p2")


def routed(tasks: DataFrame, routes: DataFrame, other: str) -> DataFrame:
    """tasks with the model of their type and complexity, or of the type alone, or the other one."""
    exact = routes.where("complexity IS NOT NULL").select("task_type", "complexity", F.col("model").alias("m1"))
    usual = routes.where("complexity IS NULL").select("task_type", F.col("model").alias("m2"))
    found = tasks.join(exact, ["task_type", "complexity"], "left").join(usual, "task_type", "left")
    return found.withColumn("model", F.coalesce("m1", "m2", F.lit(other))).drop("m1", "m2")


def next_models(rows: DataFrame, ladder: DataFrame) -> DataFrame:
    """rows (model, tier) with the next model: the ladder's next rung, or off the ladder its first of a higher tier; null at the top.

    ladder (place, model, tier) is a policy table of a few rows.
    """
    order = Window.orderBy("place")
    rungs = ladder.select(F.col("model"), F.lead("model").over(order).alias("up"), F.lit(True).alias("on"))
    higher = ladder.groupBy("tier").agg(F.min_by("model", "place").alias("model"), F.min("place").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "tier", "model"))).alias("all"))
    found = rows.join(rungs, "model", "left").crossJoin(F.broadcast(higher))  # one row
    first = F.try_element_at(F.filter("all", lambda x: x["tier"] > F.col("tier")), F.lit(1))["model"]
    return found.withColumn("next", F.when(F.col("on"), F.col("up")).otherwise(first)).drop("up", "on", "all")


def cascade(questions: DataFrame, backends: list[tuple[str, Callable[[DataFrame], DataFrame]]], least: float, key: str = "question", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """key, answer, confidence, backend, needs_human: each backend sees only what is still open, the cheapest first.

    A backend maps questions to (key, answer, confidence, refused). What nobody settles gets the best answer seen. Each
    level's answers are kept as a written table, by `keep(answers, backend)` where given, so a lost executor doesn't make
    a backend answer again.
    """
    left, answers = questions, None
    for place, (name, decide) in enumerate(backends):
        got = decide(left).select(key, "answer", "confidence", "refused", F.lit(name).alias("backend"), F.lit(-place).alias("_place"))
        if place < len(backends) - 1:  # asked once, though the answers are read twice
            got = (keep or held)(got, name)
        settled = got.where(~F.col("refused") & (F.col("confidence") >= least))
        answers = got if answers is None else answers.unionByName(got)
        left = left.join(settled.select(key), key, "left_anti")
    good = ~F.col("refused") & (F.col("confidence") >= least)
    best = answers.groupBy(key).agg(F.max(F.struct(good.alias("good"), (~F.col("refused")).alias("said"), "confidence", "_place", "answer", "backend")).alias("b"))
    return questions.select(key).join(best, key, "left").select(
        key, F.when(F.col("b.said"), F.col("b.answer")).alias("answer"), F.col("b.confidence").alias("confidence"), F.col("b.backend").alias("backend"), (~F.coalesce(F.col("b.good"), F.lit(False))).alias("needs_human"),
    )


def planned_cascade(questions: DataFrame, backends: dict[str, Callable[[DataFrame], DataFrame]], least: float, key: str = "question", keep: Callable[[DataFrame, str], DataFrame] = held) -> DataFrame:
    """As `cascade`, but each question visits the backends of its own `plan` (an array of names), in that order.

    Step by step, a backend sees the open questions whose plan names it there; its answers are kept as a written table.
    The steps are as many as there are backends, as a plan names each once. Columns `place` and `asked` tell at which
    step of its plan the answer was given and how many backends were asked."""
    left, answers = questions, None
    for step in range(len(backends)):
        settled = None
        for name, decide in backends.items():
            own = left.where(F.get("plan", F.lit(step)) == name)
            got = keep(decide(own).select(key, "answer", "confidence", "refused", F.lit(name).alias("backend"), F.lit(-step).alias("_place")), f"{name}-{step}")
            answers = got if answers is None else answers.unionByName(got)
            done = got.where(~F.col("refused") & (F.col("confidence") >= least)).select(key)
            settled = done if settled is None else settled.unionByName(done)
        left = left.join(settled, key, "left_anti")
    good = ~F.col("refused") & (F.col("confidence") >= least)
    best = answers.groupBy(key).agg(F.max(F.struct(good.alias("good"), (~F.col("refused")).alias("said"), "confidence", "_place", "answer", "backend")).alias("b"), F.count("*").alias("asked"))
    return questions.select(key).join(best, key, "left").select(
        key, F.when(F.col("b.said"), F.col("b.answer")).alias("answer"), F.col("b.confidence").alias("confidence"), F.col("b.backend").alias("backend"), (-F.col("b._place")).alias("place"),
        F.coalesce("asked", F.lit(0)).alias("asked"), (~F.coalesce(F.col("b.good"), F.lit(False))).alias("needs_human"),
    )
