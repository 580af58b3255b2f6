"""The transaction log: sequence checks, replay, idempotency, retention, cursors, snapshots, and the newest-wins index."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequence_gaps(log: DataFrame) -> DataFrame:
    """(ns, seq, problem): where a namespace's sequence isn't contiguous from 1, or a digest doesn't continue the chain."""
    w = Window.partitionBy("ns").orderBy("seq")
    seen = log.withColumn("p", F.lag("seq").over(w)).withColumn("d", F.lag("digest").over(w))
    gap = F.col("seq") != F.coalesce(F.col("p") + 1, F.lit(1))
    broken = ~F.col("prev_digest").eqNullSafe(F.col("d"))
    return seen.select("ns", "seq", F.when(gap, "gap").when(broken, "chain").alias("problem")).where("problem IS NOT NULL")


def ordered_fold(rows: DataFrame, key: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple | None]]) -> DataFrame:
    """Rows of `schema` from folding each key's rows in order: step(state, row) gives the next state and a row of output, or none.

    A key's rows stream through its task in order; only the state is held, however many rows there are. Different keys go to different tasks.
    """
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            at = [batch.columns.get_loc(k) for k in key]
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                own = tuple(row[k] for k in at)
                if own != last or state is None:
                    last, state = own, start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def chain_digests(log: DataFrame) -> DataFrame:
    """(ns, seq, chained): each event's digest hashed with the chain before it."""

    def step(state: str, row: tuple) -> tuple[str, tuple]:
        state = hashlib.sha256((state + row[2]).encode()).hexdigest()
        return state, (row[0], row[1], state)

    return ordered_fold(log.select("ns", "seq", "digest"), ["ns"], ["seq"], "ns long, seq long, chained string", str, step)


def skew_verdict(ts: Column, now: Column, skew_s: int) -> Column:
    """Late or Early: beyond the skew of now, in seconds; else null. Both bounds are inclusive."""
    age = now - ts
    return F.when(age > skew_s * 1_000_000, "Late").when(age < -skew_s * 1_000_000, "Early")


def judged_nonce(accepted: int | None, ts: int, ttl_us: int) -> tuple[int, str]:
    """What a nonce accepted at a time before (none: never) makes of a request, and when it counts as accepted from here on."""
    if accepted is not None and ts - accepted <= ttl_us:
        return accepted, "Replayed"
    return ts, "Fresh"


def replay_verdicts(requests: DataFrame, ttl_s: int = 600, skew_s: int = 300) -> DataFrame:
    """(request, verdict) of requests (request, key, nonce, ts_us, now_us), by time and then request.

    Late or Early beyond the skew; these are refused unseen and leave no trace. Replayed within the time to live of the last *accepted* request of the
    same key and nonce: a replay extends nothing. Else Fresh, and accepted.
    """
    marked = requests.withColumn("skewed", skew_verdict(F.col("ts_us"), F.col("now_us"), skew_s))

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        if row[4] is not None:
            return state, (row[2], row[4])
        accepted, verdict = judged_nonce(state[0], row[3], ttl_s * 1_000_000)
        return (accepted,), (row[2], verdict)

    return ordered_fold(marked.select("key", "nonce", "request", "ts_us", "skewed"), ["key", "nonce"], ["ts_us", "request"], "request long, verdict string", lambda: (None,), step)


def bounded_replay(requests: DataFrame, ttl_s: int, most: int) -> DataFrame:
    """(request, verdict) of requests (ns, request, nonce, ts_us): as an instance with room for `most` nonces judges them in order of time.

    Full: no nonce within its time to live is forgotten to make room, so the request is refused. One instance (ns) is one ordered fold.
    """
    ttl = ttl_s * 1_000_000

    def step(state: dict, row: tuple) -> tuple[dict, tuple]:
        _, request, nonce, ts = row
        if nonce in state and ts - state[nonce] <= ttl:
            return state, (request, "Replayed")
        if len(state) >= most:
            for gone in [n for n, t in state.items() if ts - t > ttl]:
                del state[gone]
        if nonce not in state and len(state) >= most:
            return state, (request, "Full")
        state[nonce] = ts
        return state, (request, "Fresh")

    return ordered_fold(requests.select("ns", "request", "nonce", "ts_us"), ["ns"], ["ts_us", "request"], "request long, verdict string", dict, step)


def coalescing(durable: Column, registered: Column, incoming: Column) -> Column:
    """What a submission becomes: a durable digest decides before one that is only registered, in flight; null: there is none."""
    return (
        F.when(durable.isNotNull(), F.when(durable == incoming, "ReturnDurable").otherwise("OperationIdMismatch"))
        .when(registered.isNull(), "BecomeLeader")
        .when(registered == incoming, "AttachToLeader")
        .otherwise("OperationIdMismatch")
    )


def deadline(now: Column, retry_until: Column, started: Column) -> Column:
    """Once an append has started its resolution decides, not the clock; before, it must not be later than the deadline."""
    return F.when(started, "RemainResolving").when(now > retry_until, "RejectReceiptExpired").otherwise("ContinuePreAppend")


def idempotent_outcomes(submissions: DataFrame) -> DataFrame:
    """(ns, op_id, attempt, outcome): the first attempt leads; a later one with its digest returns the durable result, another digest is a mismatch."""
    w = Window.partitionBy("ns", "op_id").orderBy("attempt")
    first = F.first("digest").over(w)
    outcome = F.when(F.row_number().over(w) == 1, "BecomeLeader").when(F.col("digest") == first, "ReturnDurable").otherwise("OperationIdMismatch")
    return submissions.select("ns", "op_id", "attempt", outcome.alias("outcome"))


def retry_window(issued: Column, deadline: Column, now: Column, skew_us: int, max_us: int) -> Column:
    """The first reason against a retry window, or `ok`."""
    return (
        F.when(F.abs(issued - now) > skew_us, "skewed")
        .when(deadline < issued, "deadline-before-issue")
        .when(deadline > issued + max_us, "too-long")
        .when(deadline < now, "expired")
        .otherwise("ok")
    )


def receipt_state(now: Column, retry_until: Column, first_visible: Column, grace_us: int, tombstone_us: int) -> Column:
    """Committed while visible, Expired while a tombstone stands, then Unknown; both bounds are inclusive."""
    visible = F.greatest(retry_until, first_visible + grace_us)
    return F.when(now <= visible, "Committed").when(now <= visible + tombstone_us, "Expired").otherwise("Unknown")


def cursor_disposition(cursors: DataFrame, log: DataFrame) -> DataFrame:
    """(ns, after, disposition): Resnapshot below the kept range, Error above it, else ReplayFrom."""
    kept = log.groupBy("ns").agg((F.min("seq") - 1).alias("low"), F.max("seq").alias("high"))
    d = F.when(F.col("after") < F.col("low"), "Resnapshot").when(F.col("after") > F.col("high"), "Error").otherwise("ReplayFrom")
    return cursors.join(kept, "ns").select("ns", "after", d.alias("disposition"), F.when(d == "ReplayFrom", F.col("high") - F.col("after")).alias("events"))


def snapshot_at(updates: DataFrame, seq: int) -> DataFrame:
    """(ns, name, target): the last value of each reference up to a sequence; deleted ones are gone."""
    last = updates.where(F.col("seq") <= seq).groupBy("ns", "name").agg(F.max_by("target", "seq").alias("target"))
    return last.where("target IS NOT NULL")


def newest_wins(entries: DataFrame) -> DataFrame:
    """(ns, object, generation, off): of each key the entry of the highest generation."""
    best = entries.groupBy("ns", "object").agg(F.max(F.struct("generation", "off")).alias("m"))
    return best.select("ns", "object", "m.generation", "m.off")


def index_pressure(entries: Column, limit: int) -> Column:
    return F.when(entries >= limit, "SealRequired").when(entries * 4 >= limit * 3, "Backpressure").otherwise("Ok")


def evict(cache: DataFrame, cap: int) -> DataFrame:
    """(path, evicted): oldest entries go until the rest fits. Entries come by (mtime, path), summed by buckets of time and then within."""
    # Days are summed first: the ordered sum within a day starts from what came before it. One row for each day there is meets in the window without a key.
    day = cache.withColumn("day", F.floor(F.col("mtime") / F.lit(86_400_000_000)))
    days = day.groupBy("day").agg(F.sum("size").alias("s"))
    total = days.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    before = days.select("day", F.coalesce(F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("day").orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)
    run = day.join(before, "day").withColumn("gone", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return run.select("path", (F.lit(total) - F.col("gone") > cap).alias("evicted"))


def store_counters(log: DataFrame) -> DataFrame:
    """(shard, transactions, commits, bytes, fences, largest_fence): durability counters of a log (shard, fence, commits, bytes)."""
    fences = log.groupBy("shard", "fence").agg(F.count("*").alias("n"), F.sum("commits").alias("c"), F.sum("bytes").alias("b"))
    return fences.groupBy("shard").agg(F.sum("n").alias("transactions"), F.sum("c").alias("commits"), F.sum("b").alias("bytes"), F.count("*").alias("fences"), F.max("n").alias("largest_fence"))


def delta_base(objects: DataFrame) -> DataFrame:
    """(id, base): the candidate an object is stored as a difference to: the one of its type just before it."""
    return objects.select("id", F.lag("id").over(Window.partitionBy("type").orderBy("pos")).alias("base"))


def form_groups(arrivals: DataFrame, txns: int = 512, size: int = 8 << 20, open_us: int = 1000) -> DataFrame:
    """(shard, op_id, grp): groups of commits that close at a count, a size, or an age since they opened; one oversize frame may stand alone."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (grp, n, held, opened), (shard, op, t, b) = state, row
        if n and (n >= txns or held + b > size or t - opened > open_us):
            grp, n, held = grp + 1, 0, 0
        return (grp, n + 1, held + b, opened if n else t), (shard, op, grp)

    return ordered_fold(arrivals.select("shard", "op_id", "ts_us", "bytes"), ["shard"], ["ts_us", "op_id"], "shard long, op_id long, grp long", lambda: (0, 0, 0, None), step)


def speculative_cas(updates: DataFrame) -> DataFrame:
    """(ns, seq, accepted): each compare-and-set against the state that earlier accepted ones of its namespace left. Held: a namespace's references."""

    def step(now: dict, row: tuple) -> tuple[dict, tuple]:
        ns, seq, name, expected, new = row
        ok = expected == now.get(name)
        if ok:
            now[name] = new
        return now, (ns, seq, ok)

    return ordered_fold(updates.select("ns", "seq", "name", "expected", "new"), ["ns"], ["seq"], "ns long, seq long, accepted boolean", dict, step)


def valid_prefix(frames: DataFrame) -> DataFrame:
    """Frames before the first that isn't whole, of each shard; whole ones after it don't count."""
    bad = frames.where("NOT whole").groupBy("shard").agg(F.min("pos").alias("bad"))
    return frames.join(bad, "shard", "left").where("bad IS NULL OR pos < bad").select(frames.columns)


def namespace_states(events: DataFrame) -> DataFrame:
    """(ns, lifecycle, refused): a namespace binds once; binding again, or advancing before it, is refused."""
    w = Window.partitionBy("ns").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.coalesce(F.max(F.col("kind") == "bind").over(w), F.lit(False))
    marked = events.withColumn("ok", F.when(F.col("kind") == "bind", ~bound).otherwise(bound))
    return marked.groupBy("ns").agg(F.max_by("lifecycle", F.when(F.col("ok"), F.col("seq"))).alias("lifecycle"), F.sum((~F.col("ok")).cast("long")).alias("refused"))


def compaction_groups(runs: list[tuple[int, int, int]], most: int) -> list[list[int]]:
    """Groups of runs (generation, entries, band) to compact, newest first: each the longest that stays within `most` entries and one band.

    A merged run answers above all that remain, so a run or group that stays behind keeps all older ones waiting; a run without entries stands in nobody's way.
    """
    groups: list[list[tuple[int, int, int]]] = []
    for run in sorted(runs, reverse=True):
        last = groups[-1] if groups else None
        if last and last[0][2] == run[2] and sum(r[1] for r in last) + run[1] <= most:
            last.append(run)
        else:
            groups.append([run])
    out = []
    for group in groups:
        if len(group) > 1:
            out.append([r[0] for r in group])
        elif group[0][1]:
            break
    return out


def compacted(entries: DataFrame, most: int) -> tuple[DataFrame, list[list[int]]]:
    """(entries, groups): the index entries (run, band, ns, object, generation, off) of the runs that a pass merges, newest wins, and those runs.

    The driver sees one row for each run: its entries counted, and its band."""
    sizes = entries.groupBy("run").agg(F.count("*").alias("n"), F.max("band").alias("band")).collect()
    groups = compaction_groups([(r["run"], r["n"], r["band"]) for r in sizes], most)
    chosen = entries.where(F.col("run").isin([r for g in groups for r in g]))
    return newest_wins(chosen), groups


#: Where each step leads from; a step from any other state is refused.
STAGING = {"put_chunk": ("Open", "Open"), "seal": ("Open", "Sealed"), "finalize": ("Sealed", "Finalizing"), "adopt": ("Finalizing", "Adopted")}


def staged(state: dict, kind: str, chunk: int | None, digest: str | None, ts: int, chunks: int, quota: int) -> str:
    """Takes one step of a staging session, in place, and says what came of it: Begun, Stored, AlreadyPresent, Moved, Aborted, or why it is refused."""
    at = state.get("state")
    if kind == "begin":
        if at is not None:
            return "refused: begun"
        state.update(state="Open", have={}, chunks=chunks, ts=ts)
        return "Begun"
    if at is None:
        return "refused: unknown"
    if kind == "abort":
        if at not in ("Open", "Sealed"):
            return f"refused: {at}"
        state.update(state="Aborted", ts=ts)
        return "Aborted"
    before, after = STAGING[kind]
    if at != before:
        return f"refused: {at}"
    if kind == "put_chunk":
        if chunk in state["have"]:
            return "AlreadyPresent" if state["have"][chunk] == digest else "refused: digest"
        if len(state["have"]) >= quota:
            return "refused: quota"
        state["have"][chunk] = digest
        state["ts"] = ts
        return "Stored"
    if kind == "seal" and len(state["have"]) != state["chunks"]:
        return "refused: incomplete"
    state.update(state=after, ts=ts)
    return "Moved"


def staging_steps(events: DataFrame, quota: int = 1 << 16) -> DataFrame:
    """(session, seq, outcome, state, chunks) of events (session, seq, kind, chunk, digest, ts_us, total): what each step of a staging session comes to.

    begin names the session's chunks (total); a chunk put twice is AlreadyPresent, with another digest refused; only a complete session is
    sealed; steps out of their state are refused and change nothing.
    """

    def step(state: dict, row: tuple) -> tuple[dict, tuple]:
        session, seq, kind, chunk, digest, ts, total = row
        outcome = staged(state, kind, chunk, digest, ts, total, quota)
        return state, (session, seq, outcome, state.get("state"), len(state.get("have", ())))

    return ordered_fold(events.select("session", "seq", "kind", "chunk", "digest", "ts_us", "total"), ["session"], ["seq"], "session long, seq long, outcome string, state string, chunks long", dict, step)


def staging_states(events: DataFrame, now_us: int, idle_us: int, quota: int = 1 << 16) -> DataFrame:
    """(session, state, chunks, refused): where each session stands at now_us: Open, Sealed, Finalizing, Adopted, Aborted, or Expired: only open
    and sealed sessions expire, so long after the last step that changed them. Sessions that never began have no row."""
    steps = staging_steps(events, quota).join(events.select("session", "seq", "ts_us"), ["session", "seq"])
    took = F.when(F.col("outcome").isin("Begun", "Stored", "Moved", "Aborted"), F.col("ts_us"))
    last = steps.groupBy("session").agg(F.max_by("state", "seq").alias("state"), F.max_by("chunks", "seq").alias("chunks"), F.max(took).alias("at"), F.sum(F.col("outcome").startswith("refused").cast("long")).alias("refused"))
    idle = F.lit(now_us) - F.col("at") > idle_us
    return last.where("state IS NOT NULL").select("session", F.when(F.col("state").isin("Open", "Sealed") & idle, "Expired").otherwise(F.col("state")).alias("state"), "chunks", "refused")


def leases(reads: DataFrame, log: DataFrame) -> DataFrame:
    """(reader, ns, seq, held): a reader's lease on a snapshot (reader, ns, token, seq), held if its token is bound to that reader and sequence, and the sequence is kept."""
    kept = log.groupBy("ns").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    bound = F.sha2(F.concat_ws(":", "reader", F.col("ns").cast("string"), F.col("seq").cast("string")), 256)
    return reads.join(kept, "ns", "left").select("reader", "ns", "seq", F.coalesce((F.col("token") == bound) & (F.col("seq") >= F.col("low") - 1) & (F.col("seq") <= F.col("high")), F.lit(False)).alias("held"))


def shard_of(ns: Column, shards: int) -> Column:
    """The shard of a namespace: its first two bytes, little-endian, modulo the shards."""
    return F.conv(F.concat(F.substring(ns, 3, 2), F.substring(ns, 1, 2)), 16, 10).cast("long") % shards
