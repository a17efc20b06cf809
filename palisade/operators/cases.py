"""Case workflow over tables of requests.

Requests: incident_id, seq (order), and the requested change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from palisade.functions.core import blank, uuid5
from palisade.functions.state import checkpointed
from palisade.operators.ordering import Fold, prefix_scan

# Allowed status changes.
TRANSITIONS = {
    "NEW": ("INVESTIGATING",),
    "INVESTIGATING": ("CONTAINED", "RESOLVED"),
    "CONTAINED": ("INVESTIGATING", "RESOLVED"),
    "RESOLVED": (),
}
NOTE_MAX = 5000
IDENTIFIER_MAX = 128
ACTIVITY_NAMESPACE = "0f4a5d6c7b8e59a1b2c3d4e5f60718ab"


def case_transitions(requests: DataFrame, initial: str = "NEW", chunk: int = 500) -> DataFrame:
    """Fold each incident's ordered status requests through the transition table.

    One row per request: previous status, accepted, reason when rejected, and the
    status afterwards. A request is a map from states to states, and maps compose: each
    run of `chunk` requests is folded for every state it may begin in, the maps of an
    incident's runs are chained, and runs are replayed from the state they really begin in.
    So an incident of any length is many tasks of bounded size.
    """
    states = list(TRANSITIONS)
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items()
                             for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    log_type = "array<struct<seq:bigint,status:string,before:string,accepted:boolean>>"

    def ok(now, status):
        return F.coalesce(status.isin(*states) & F.array_contains(F.element_at(allowed, now), status), F.lit(False))

    def follow(acc, r):
        return F.transform(acc, lambda now: F.when(ok(now, r["status"]), r["status"]).otherwise(now))

    def replay(acc, r):
        good = ok(acc["now"], r["status"])
        entry = F.struct(r["seq"].cast("bigint").alias("seq"), r["status"].alias("status"),
                         acc["now"].alias("before"), good.alias("accepted"))
        return F.struct(F.when(good, r["status"]).otherwise(acc["now"]).alias("now"),
                        F.concat(acc["log"], F.array(entry)).alias("log"))

    def enter(acc, c):
        """States at the start of each run, and after the last."""
        now = F.element_at(c["exits"], F.array_position(F.array(*map(F.lit, states)), acc["now"]).cast("int"))
        return F.struct(now.alias("now"), F.concat(acc["starts"], F.array(acc["now"])).alias("starts"))

    rows = prefix_scan(requests.select("incident_id", "seq", "status"), ["incident_id"], ["seq", "status"], {"rn": Fold("sum", F.lit(1))})
    runs = checkpointed(rows.groupBy("incident_id", F.floor((F.col("rn") - 1) / chunk).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("steps")).withColumn(
        "exits", F.aggregate("steps", F.array(*map(F.lit, states)), follow)))
    begin = F.struct(F.lit(initial).alias("now"), F.array().cast("array<string>").alias("starts"))
    chained = runs.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("run", "exits"))).alias("chain")).select(
        F.col("incident_id").alias("_i"), F.posexplode(F.aggregate("chain", begin, enter)["starts"]).alias("_run", "start"))
    start = F.struct(F.col("start").alias("now"), F.array().cast(log_type).alias("log"))
    folded = runs.join(chained, F.col("incident_id").eqNullSafe(F.col("_i")) & (F.col("run") == F.col("_run"))).select(
        "incident_id", F.explode(F.aggregate("steps", start, replay)["log"]).alias("e"))
    e = F.col("e")
    choices = F.array_join(F.element_at(allowed, e["before"]), ", ")
    reason = F.when(e["accepted"], None).when(
        ~F.coalesce(e["status"].isin(*TRANSITIONS), F.lit(False)),
        F.concat(F.lit("invalid status '"), F.coalesce(e["status"], F.lit("None")),
                 F.lit("'; expected one of " + ", ".join(TRANSITIONS)))).otherwise(
        F.concat(F.lit("invalid transition '"), e["before"], F.lit("' -> '"), e["status"],
                 F.lit("'; allowed: "), F.when(choices == "", "none").otherwise(choices)))
    return folded.select(
        "incident_id", e["seq"].alias("seq"), e["status"].alias("requested"), e["before"].alias("before"),
        e["accepted"].alias("accepted"), F.when(e["accepted"], e["status"]).otherwise(e["before"]).alias("after"),
        reason.alias("reason"))


def case_assign(requests: DataFrame) -> DataFrame:
    """Assignment changes; a request repeating the current assignee changes nothing.

    `assignee` NULL clears; a blank or over-long one is rejected.
    """
    name = F.trim("assignee")
    valid = F.col("assignee").isNull() | ((name != "") & (F.length(name) <= IDENTIFIER_MAX))
    w = W.partitionBy("incident_id").orderBy("seq")
    kept = requests.where(valid).withColumn("assignee", name)
    before = F.lag("assignee").over(w)
    return kept.withColumn("before", before).where(~F.col("assignee").eqNullSafe(F.col("before"))).select(
        "incident_id", "seq", "before", "assignee",
        F.when(F.col("assignee").isNull(), "UNASSIGNED").otherwise("ASSIGNED").alias("action"))


def case_notes(notes: DataFrame) -> DataFrame:
    """Notes with trimmed body and author, a stable id, and why one is refused."""
    body, author = F.trim(F.coalesce("body", F.lit(""))), F.trim("author")
    refused = (
        F.when(body == "", "invalid note body: expected non-empty plain text")
        .when(F.length(body) > NOTE_MAX, f"invalid note body: exceeds {NOTE_MAX} characters")
        .when(F.col("author").isNotNull() & (author == ""),
              "invalid author: expected a non-empty string or null")
        .when(F.length(author) > IDENTIFIER_MAX, f"invalid author: exceeds {IDENTIFIER_MAX} characters"))
    note_id = F.concat(F.lit("note-"), F.substring(F.md5(
        F.concat_ws("|", "incident_id", F.col("seq").cast("string"))), 1, 12))
    return notes.select("incident_id", "seq", note_id.alias("note_id"), author.alias("author"),
                        body.alias("body"), refused.alias("refused"))


def case_activity(transitions: DataFrame, assignments: DataFrame, notes: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """One activity row per accepted change, with who made it.

    `actors` (incident_id, seq, actor) names who asked for a change; a note's actor is its author.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    rows = (
        transitions.where("accepted").select(
            "incident_id", "seq", F.lit("STATUS_CHANGED").alias("action"), text("before").alias("from_value"),
            text("after").alias("to_value"))
        .unionByName(assignments.select(
            "incident_id", "seq", "action", text("before").alias("from_value"), text("assignee").alias("to_value")))
        .unionByName(notes.where("refused IS NULL").select(
            "incident_id", "seq", F.lit("NOTE_ADDED").alias("action"), none.alias("from_value"),
            F.col("note_id").alias("to_value"), text("author").alias("actor")), allowMissingColumns=True)
    )
    if actors is not None:
        asked = actors.select("incident_id", "seq", F.nullif(F.trim("actor"), F.lit("")).alias("asked_by"))
        noted = F.col("action") == "NOTE_ADDED"
        rows = rows.join(asked, ["incident_id", "seq"], "left").withColumn(
            "actor", F.when(noted, F.col("actor")).otherwise(F.col("asked_by"))).drop("asked_by")
    return rows.withColumn("activity_id", uuid5(ACTIVITY_NAMESPACE, F.concat_ws(
        "|", "incident_id", F.col("seq").cast("string"), "action")))
