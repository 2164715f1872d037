"""Row-wise decisions: routing, gates, checklists, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Order of stages of ingestion.
STAGES = ("analysis", "segmented", "paraphrased", "chunked", "figures", "ready")


def novelty_score(bucket_new: Column, format_new: Column, channel_new: Column, *, angle: int = 2, bucket: int = 3, kind: int = 2, channel: int = 1) -> Column:
    """Weights of what the brand has never used; the angle always counts."""
    part = lambda flag, w: F.when(flag, w).otherwise(0)
    return part(bucket_new, bucket) + part(format_new, kind) + part(channel_new, channel) + F.lit(angle)


def route(similarity: Column, current: Column, score: Column, *, duplicate: float = 0.86, threshold: int = 4) -> Column:
    """A near copy repeats what is current or returns to the prior; else the score decides between new and refine."""
    return F.when((similarity >= duplicate) & current, "repeat").when(similarity >= duplicate, "prior").when(score >= threshold, "new").otherwise("refine")


def first_used(rows: DataFrame, brand: str, value: str, order: str, keys: list[str]) -> DataFrame:
    """rows with `_new`: no earlier row of the brand has the value."""
    w = Window.partitionBy(brand, value).orderBy(order, *keys)
    return rows.withColumn("_new", F.row_number().over(w) == 1)


def checklist(checks: dict[str, Column], soft: set[str]) -> tuple[Column, Column]:
    """(verdict, failed names): any failed hard check fails, a failed soft one asks a human."""
    failed = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    hard = F.filter(failed, lambda x: ~x.isin(*soft))
    return F.when(F.size(hard) > 0, "fail").when(F.size(failed) > 0, "human_review").otherwise("pass"), failed


def gate(risk: Column, verdict: Column, route_: Column) -> Column:
    """Whether a piece may be published."""
    return F.when(verdict == "fail", "blocked").when((risk == "high") | (verdict == "human_review"), "human").when(route_ == "prior", "human").otherwise("publish")


def fuse_verdicts(rule: Column, model: Column) -> Column:
    """The model may only raise severity, and its fail counts as review."""
    level = lambda c: F.when(c == "fail", 2).when(c == "human_review", 1).otherwise(0)
    merged = F.greatest(level(rule), F.least(level(model), F.lit(1)))
    return F.when(merged == 2, "fail").when(merged == 1, "human_review").otherwise("pass")


def normalised_items(expected: DataFrame, got: DataFrame) -> DataFrame:
    """id, item, status: what was not covered is not evaluated, never ok."""
    return expected.join(got, ["id", "item"], "left").withColumn("status", F.coalesce("status", F.lit("not_evaluated")))


def covers(item: Column, lines: Column) -> Column:
    """A line that starts with the item and a colon or blank."""
    return F.exists(lines, lambda x: x.startswith(F.concat(item, F.lit(":"))) | x.startswith(F.concat(item, F.lit(" "))))


def after_critic(verdict: Column, iteration: Column, most: int = 3) -> Column:
    return F.when(verdict == "pass", "gate").when(iteration >= most, "human_review").otherwise("producer")


def order_state(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """key, state: an event log folded through the allowed transitions; others are ignored.

    draft -approve-> approved -produce-> produced -publish-> published; reject returns to draft.
    """
    each = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, kind))).alias("_log"))

    def step(state: Column, e: Column) -> Column:
        k = e[kind]
        return (
            F.when((state == "draft") & (k == "approve"), "approved").when((state == "approved") & (k == "produce"), "produced")
            .when((state == "produced") & (k == "publish"), "published").when((state != "published") & (k == "reject"), "draft").otherwise(state)
        )

    return each.select(key, F.aggregate("_log", F.lit("draft"), step).alias("state"))


def reindex_action(known: Column, same_hash: Column, status: Column, missing_vectors: Column, force: Column) -> Column:
    """What to do with a document already or not yet indexed."""
    return F.when(force | ~known, "rebuild").when(~same_hash, "rebuild").when(status == "failed", "resume").when(missing_vectors > 0, "re_embed").otherwise("skip")


def run_chain(steps: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """steps up to and with the first failure of each key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("_before", F.coalesce(F.max(F.col(failed).cast("int")).over(w), F.lit(0))).filter("_before = 0").drop("_before")


def may_approve(role: Column, state: Column) -> Column:
    """Editors approve drafts; an administrator also what is produced."""
    return (role.isin("admin", "editor") & (state == "draft")) | ((role == "admin") & (state == "produced"))


def snapshot(rows: DataFrame, given: str, required: tuple[str, ...], flags: tuple[str, ...] = (), placeholder: str = "pending") -> DataFrame:
    """rows with key, value for every required key of the map `given`: blanks are the placeholder, flags are true, false or the placeholder."""
    each = rows.withColumn("key", F.explode(F.array(*map(F.lit, required))))
    value = F.try_element_at(F.col(given), F.col("key"))
    plain = F.nullif(F.trim(value), F.lit(""))
    return each.withColumn("value", F.coalesce(F.when(F.col("key").isin(*flags), X.to_flag(plain).cast("string")).otherwise(plain), F.lit(placeholder)))
