"""Memory lifecycle (P8, P9, A16) and learning proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork import schemas as S
from skeinwork.functions import scalars as C
from skeinwork.operators.ledger import duplicate_groups


def gc_actions(memory: DataFrame, now: Column, half_life_days: float = S.HALF_LIFE_DAYS, session_ttl: int = S.SESSION_TTL) -> DataFrame:
    """P8, first half: every record with action (keep, delete, archive, decay) and its salience and status afterwards.

    An expired session record is deleted, any other archived; the rest decay.  Records that are not active stay as they are.
    """
    gone = C.is_expired("last_accessed_at", now, C.effective_ttl("ttl_seconds", "scope", session_ttl))
    fresh = C.salience("last_accessed_at", now, half_life_days)
    live = F.col("status") == "active"
    action = F.when(~live, "keep").when(gone & (F.col("scope") == "session"), "delete").when(gone, "archive").when(fresh != F.col("salience"), "decay").otherwise("keep")
    out = memory.withColumn("action", action)
    return out.withColumn("salience", F.when(F.col("action") == "decay", fresh).otherwise(F.col("salience"))).withColumn("status", F.when(F.col("action") == "archive", "archived").otherwise(F.col("status")))


def after_gc(actions: DataFrame) -> DataFrame:
    return actions.filter("action <> 'delete'").drop("action")


def promotions(memory: DataFrame, threshold: int = S.PROMOTE_AT) -> DataFrame:
    """A proposal for each active session record that is used often."""
    often = memory.filter((F.col("scope") == "session") & (F.col("status") == "active") & (F.col("access_count") >= threshold))
    return often.select(
        C.surrogate_id("prop", F.lit("memory.promotion"), "id").alias("id"), F.lit("memory.promotion").alias("kind"), F.col("id").alias("subject"),
        F.concat(F.lit("accessed "), F.col("access_count").cast("string"), F.lit("x in session")).alias("evidence"), F.when(F.col("access_count") >= S.PROMOTE_HIGH, "high").otherwise("medium").alias("reuse_value"), F.lit("proposed").alias("status"),
    )


def consolidations(memory: DataFrame) -> DataFrame:
    """A proposal for each group of equal project or user records."""
    return duplicate_groups(memory).select(
        C.surrogate_id("prop", F.lit("memory.consolidation"), "scope", "hash").alias("id"), F.lit("memory.consolidation").alias("kind"), F.col("ids").alias("subject"),
        F.concat(F.col("n").cast("string"), F.lit(" duplicate records in "), "scope").alias("evidence"), F.lit("medium").alias("reuse_value"), F.lit("proposed").alias("status"),
    )


def gc_ids(actions: DataFrame) -> DataFrame:
    """(action, id) of the records that went or were archived."""
    return actions.filter("action in ('delete', 'archive')").select("action", "id")


def gc_report(actions: DataFrame, memory_after: DataFrame) -> DataFrame:
    """One row: how many records went, were archived and decayed, and how many proposals of each kind; gc_ids has the ids."""
    out = actions.agg(F.count_if(F.col("action") == "delete").alias("n_expired"), F.count_if(F.col("action") == "archive").alias("n_archived"), F.count_if(F.col("action") == "decay").alias("decayed"))
    return out.join(promotions(memory_after).agg(F.count("*").alias("promotions"))).join(consolidations(memory_after).agg(F.count("*").alias("consolidations")))


def added(memory: DataFrame, new: DataFrame, dedup: bool = True) -> DataFrame:
    """The new records that go in: of equal scope, kind and content only one, and none that an active record has."""
    if not dedup:
        return new
    keyed = new.withColumn("__hash", C.content_hash("scope", "kind", "content"))
    here = memory.filter("status = 'active'").select("scope", C.content_hash("scope", "kind", "content").alias("__hash"))
    left = keyed.join(here, ["scope", "__hash"], "left_anti")
    w = Window.partitionBy("scope", "__hash").orderBy("created_at", "id")
    return left.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*new.columns)


def touched(memory: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One more access and full salience for the records named."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    out = memory.join(hit, "id", "left")
    on = F.coalesce(F.col("__hit"), F.lit(False))
    return out.withColumn("access_count", F.col("access_count") + on.cast("long")).withColumn("salience", F.when(on, 1.0).otherwise(F.col("salience"))).withColumn("last_accessed_at", F.when(on, now).otherwise(F.col("last_accessed_at"))).drop("__hit")


# ---- proposals


def proposed(requests: DataFrame) -> DataFrame:
    """New proposals (id, kind, payload, status, provenance) from requests (key, kind, payload)."""
    empty = F.array().cast("array<struct<action: string, actor: string, note: string, from_status: string, to_status: string, at: string>>")
    return requests.select(C.surrogate_id("prop", "kind", "key").alias("id"), "kind", "payload", F.lit("proposed").alias("status"), empty.alias("provenance"))


_ENTRY = "struct<action: string, actor: string, note: string, from_status: string, to_status: string, at: string>"


def _target(action: Column, status: Column) -> Column:
    """The status that an action leads to; null if it is not allowed."""
    out = F.lit(None).cast("string")
    for name, before, after in S.TRANSITIONS:
        out = F.when((action == name) & (status == before), after).otherwise(out)
    return out


def decided(proposals: DataFrame, actions: DataFrame) -> DataFrame:
    """P10: proposals after their actions (id, action, actor, note, at), taken in the order of at, action and actor.

    done are the actions that took effect; error says what is wrong with the last one refused.  refused has those of proposals that do not exist.
    """
    steps = actions.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "action", "actor", F.coalesce("note", F.lit("")).alias("note")))).alias("steps"))
    given = proposals.join(steps, "id", "left").withColumn("provenance", F.col("provenance").cast(f"array<{_ENTRY}>"))
    start = F.struct(F.col("status").alias("status"), F.col("provenance").alias("provenance"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        to = _target(x["action"], acc["status"])
        entry = F.struct(x["action"].alias("action"), x["actor"].alias("actor"), x["note"].alias("note"), acc["status"].alias("from_status"), to.alias("to_status"), x["at"].cast("string").alias("at")).cast(_ENTRY)
        refused = F.concat(F.lit("cannot "), x["action"], F.lit(" a proposal in status "), acc["status"])
        return F.struct(
            F.coalesce(to, acc["status"]).alias("status"), F.when(to.isNotNull(), F.array_append(acc["provenance"], entry)).otherwise(acc["provenance"]).alias("provenance"),
            F.when(to.isNull(), refused).otherwise(acc["error"]).alias("error"), F.when(to.isNotNull(), F.array_append(acc["done"], x["action"])).otherwise(acc["done"]).alias("done"),
        )

    rest = [c for c in proposals.columns if c not in ("status", "provenance")]
    return given.select(*rest, F.aggregate(F.coalesce("steps", F.array().cast("array<struct<at: string, action: string, actor: string, note: string>>")), start, step).alias("x")).select(*rest, "x.*")


def refused(proposals: DataFrame, actions: DataFrame) -> DataFrame:
    """P10: (id, action, error) of actions on proposals that do not exist."""
    return actions.join(proposals.select("id"), "id", "left_anti").select("id", "action", F.concat(F.lit("unknown proposal "), "id").alias("error"))


def skills(after: DataFrame) -> DataFrame:
    """P10: a Skill node for each proposal just committed, named by its payload, else by its kind."""
    name = F.coalesce(F.nullif(F.get_json_object("payload", "$.name"), F.lit("")), F.nullif(F.get_json_object("payload", "$.title"), F.lit("")), F.col("kind"))
    return after.filter(F.array_contains("done", "commit")).select(C.surrogate_id("skill", "id").alias("id"), F.lit("Skill").alias("type"), name.alias("label"), F.to_json(F.struct(F.col("id").alias("proposal_id"), "kind")).alias("props"))
