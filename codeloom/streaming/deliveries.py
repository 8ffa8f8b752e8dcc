"""Keyed folds over event streams: once-only intake, latest-wins, last state and bounded memory; in batch and as streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_S = 24 * 3600
_ACCEPTED = "key long, at long, event long, accepted boolean"


def _first_in_ttl(ttl_us: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, 0
        for batch in batches:
            keys, at = batch.column("key").to_numpy(), batch.column("at").to_numpy()
            accepted = np.zeros(len(keys), bool)
            i = 0
            while i < len(keys):
                if keys[i] != key or at[i] >= until:
                    key, until = keys[i], at[i] + ttl_us
                    accepted[i] = True
                # jump to the next row of another key, or the first of this key past its time
                same = np.searchsorted(keys[i:], key, side="right") + i
                i = max(i + 1, i + np.searchsorted(at[i:same], until))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), batch.column("event"), pa.array(accepted)], schema=pa.schema([("key", pa.int64()), ("at", pa.int64()), ("event", pa.int64()), ("accepted", pa.bool_())]))

    return fold


def accepted_once(events: DataFrame, key: list[str], at: str, event: str, ttl_s: int = DAY_S) -> DataFrame:
    """(event, accepted): whether an event starts a new period of its key. A period runs ``ttl_s`` seconds from the accepted event; what
    comes within it is a duplicate and doesn't prolong it.

    Events of one key count in order of time, then of ``event``; rows with a null time or event are left out, null key parts are
    parts like others. A key's periods follow from each other, so one task reads its events in order, as a sorted stream with
    constant memory; it looks only at the starts of periods. Keys are compared by a 64-bit hash.
    """
    rows = events.select(F.xxhash64(*key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(event).cast("long").alias("event")).dropna()
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "event")
    return ordered.mapInArrow(_first_in_ttl(ttl_s * 1_000_000), _ACCEPTED).select(F.col("event").alias(event), "accepted")


def stream_once(deliveries: DataFrame, key: list[str], at: str, ttl: str = "24 hours") -> DataFrame:
    """The streaming form: of a streaming DataFrame, the first delivery of each key within the watermark. Drop what isn't acceptable
    before, so that a refused delivery can come again."""
    return deliveries.withWatermark(at, ttl).dropDuplicatesWithinWatermark(key)


def routed(events: DataFrame, body: str = "body", schema: str = "action string, ref string, after string, deleted boolean, draft boolean, default_branch string, comment string, association string", kind: str = "kind") -> DataFrame:
    """``events`` with ``route``: ping, push, pull_request, comment, ignored or malformed (unreadable JSON).

    A push counts on the default branch with a commit of 40 to 64 hexadecimal digits and not deleted; a pull request when opened,
    reopened, synchronised or made ready and no draft; a comment of an owner, member or collaborator that gives a command.
    """
    parsed = events.withColumn("_e", F.from_json(body, schema))
    x = lambda c: F.col(f"_e.{c}")
    on = lambda c: F.coalesce(c, F.lit(False))
    push = on(x("ref") == F.concat(F.lit("refs/heads/"), x("default_branch"))) & on(x("after").rlike("^[0-9a-fA-F]{40,64}$")) & ~on(x("deleted"))
    pull = on(x("action").isin("opened", "reopened", "synchronize", "ready_for_review")) & ~on(x("draft"))
    comment = on(x("action") == "created") & on(x("association").isin("OWNER", "MEMBER", "COLLABORATOR")) & on(F.btrim(x("comment")).rlike("^/[a-z]"))
    bad = F.expr(f"try_parse_json({body}) is null")
    route = F.when(F.col(body).isNull() | bad, "malformed").when(F.col(kind) == "ping", "ping").when((F.col(kind) == "push") & push, "push").when((F.col(kind) == "pull_request") & pull, "pull_request").when((F.col(kind) == "issue_comment") & comment, "comment")
    return parsed.withColumn("route", F.coalesce(route, F.lit("ignored"))).drop("_e")


def latest_wins(events: DataFrame, key: list[str], at: str, event: str) -> DataFrame:
    """(key, event, superseded): of the events of a key only the last, by time then ``event``, is still due. One row for each event;
    the last ones are found by a map-side combined aggregation and joined back."""
    place = F.struct(at, event)
    last = events.where(F.col(at).isNotNull() & F.col(event).isNotNull()).groupBy(*key).agg(F.max(place).alias("last"))
    return events.where(F.col(at).isNotNull() & F.col(event).isNotNull()).select(*key, event, place.alias("here")).join(last, key).select(*key, event, (F.col("here") < F.col("last")).alias("superseded"))


def last_states(events: DataFrame, key: list[str], at: str, state: str, event: str, log: int = 100) -> DataFrame:
    """(key, state, n_events, log): the last state of each key and its last ``log`` states in order, as text joined by commas."""
    rows = events.where(F.col(at).isNotNull())
    last = rows.groupBy(*key).agg(F.max_by(state, F.struct(at, event)).alias("state"), F.count("*").alias("n_events"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), F.desc(event)))
    tail = rows.withColumn("place", place).where(F.col("place") <= log)
    listed = tail.groupBy(*key).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("place", F.col(state).alias("s"))))), lambda x: x["s"]), ",").alias("log"))
    return last.join(listed, key)


def next_state(current: Column, event: Column, moves: dict[tuple[str, str], str]) -> Column:
    """State after an event, by a table of moves; an event without a move leaves the state as it is."""
    out = None
    for (state, name), after in moves.items():
        hit = (current == state) & (event == name)
        out = F.when(hit, after) if out is None else out.when(hit, after)
    return current if out is None else out.otherwise(current)


def unbound(claims: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner, status) of claims: BOUND with exactly one owner, AMBIGUOUS with several, NOT_FOUND with none."""
    counts = claims.groupBy(key).agg(F.countDistinct(owner).alias("n"), F.min(owner).alias("first"))
    status = F.when(F.col("n") == 1, "BOUND").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return counts.select(key, F.when(F.col("n") == 1, F.col("first")).alias(owner), status.alias("status"))


def bindings(claims: DataFrame, repositories: DataFrame) -> DataFrame:
    """(claim, repository_id, status) of claims (claim, address, owner) on repositories (id, address, owner, null: not claimed yet).

    BOUND: one repository of the address is the owner's, or none is and just one is free, which the first claim by name gets;
    CONFLICT: another owner's claim got it; AMBIGUOUS: there are several; NOT_FOUND: none. Addresses are compared in lower case.
    """
    held = repositories.select(F.col("id").alias("repository_id"), F.lower("address").alias("address"), F.col("owner").alias("holder"))
    asked = claims.select("claim", F.lower("address").alias("address"), "owner").distinct()
    own = F.col("holder") == F.col("owner")
    counts = asked.join(held, "address", "left").groupBy("claim", "address", "owner").agg(F.count_if(own).alias("n_own"), F.min(F.when(own, F.col("repository_id"))).alias("mine"), F.count_if(F.col("repository_id").isNotNull() & F.col("holder").isNull()).alias("n_free"), F.min(F.when(F.col("holder").isNull(), F.col("repository_id"))).alias("free"))
    takes = (F.col("n_own") == 0) & (F.col("n_free") == 1)
    winner = counts.where(takes).groupBy("free").agg(F.min(F.struct("claim", "owner"))["owner"].alias("winner"))
    rows = counts.join(winner, "free", "left")
    got = takes & (F.col("winner") == F.col("owner"))
    status = F.when(F.col("n_own") > 1, "AMBIGUOUS").when(F.col("n_own") == 1, "BOUND").when(F.col("n_free") > 1, "AMBIGUOUS").when(F.col("n_free") == 0, "NOT_FOUND").when(got, "BOUND").otherwise("CONFLICT")
    return rows.select("claim", F.when(F.col("n_own") == 1, F.col("mine")).when(got, F.col("free")).alias("repository_id"), status.alias("status"))


def retries(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Retry rows (id, retry_of) for asked run ids: only for runs in state ERROR, once each; the id is ``retry:`` and the run's id."""
    failed = runs.where("status = 'ERROR'").select(F.col("id").alias("retry_of")).distinct()
    due = asked.select(F.col("id").alias("retry_of")).distinct().join(failed, "retry_of", "left_semi").select(F.concat(F.lit("retry:"), "retry_of").alias("id"), "retry_of")
    return due.join(runs.select("id"), "id", "left_anti")


def memory(messages: DataFrame, key: str, at: str, keep: int = 20) -> DataFrame:
    """The last ``keep`` messages of each key, with ``place`` counted from the newest; cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return messages.withColumn("place", place).where(F.col("place") <= keep)


def abandoned(folders: DataFrame, repositories: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Names of work folders (name, modified_at) that may go: named like a UUID, older than ``hours``, and of no repository (id)."""
    named = folders.where(F.col("name").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & (F.col("modified_at") < now - F.expr(f"interval {hours} hours")))
    return named.join(repositories.select(F.col("id").alias("name")), "name", "left_anti").select("name")


def counts_stream(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A streaming (or batch) count of events by window and ``by``; late events within the watermark count."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
