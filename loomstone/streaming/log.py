"""Streaming forms of the log operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay_guard(requests: DataFrame, ttl_s: int = 600, skew_s: int = 300) -> DataFrame:
    """(request, verdict) of a stream of requests (request, key, nonce, ts_us, now_us): as log.replay_verdicts, requests of a nonce in the order they come.

    State: the time of each nonce's last accepted request, on the requests' own clock, so how the stream is cut into batches changes nothing. The
    watermark follows the clock of arrivals (now_us) at the time to live and twice the skew: once it has passed, no request is left that the
    state could matter to, and it is dropped. Arrivals older than the watermark are, too.
    """
    from ..operators.log import judged_nonce, skew_verdict

    marked = requests.withColumn("skewed", skew_verdict(F.col("ts_us"), F.col("now_us"), skew_s))
    marked = marked.withColumn("arrived", F.timestamp_micros("now_us")).withWatermark("arrived", f"{ttl_s + 2 * skew_s} seconds")

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts_us", "request"])
        for request, ts, skewed in zip(rows["request"].tolist(), rows["ts_us"].tolist(), rows["skewed"].tolist()):
            if isinstance(skewed, str):
                out.append((request, skewed))
                continue
            accepted, verdict = judged_nonce(accepted, ts, ttl_s * 1_000_000)
            out.append((request, verdict))
        if accepted is not None:
            state.update((accepted,))
            state.setTimeoutTimestamp(max(accepted // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["request", "verdict"])

    return marked.groupBy("key", "nonce").applyInPandasWithState(judge, "request long, verdict string", "accepted long", "append", GroupStateTimeout.EventTimeTimeout)


#: Lots of operations that share a state in coalesce(); a checkpoint of a stream holds for one number only.
LOTS = 2048


def coalesce(submissions: DataFrame) -> DataFrame:
    """(ns, op_id, attempt, outcome): as idempotent_outcomes, attempts in the order they come. State: one digest for each operation, held together for the
    operations of a lot, since a worker's call for each operation costs more than its work."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(zip(state.get[0], state.get[1]), state.get[2])) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("attempt", kind="stable")
        out = []
        for ns, op, own in zip(*(rows[c].tolist() for c in ("ns", "op_id", "digest"))):
            digest = held.get((ns, op))
            out.append("BecomeLeader" if digest is None else "ReturnDurable" if own == digest else "OperationIdMismatch")
            if digest is None and own is not None:
                held[ns, op] = own
        state.update(([k[0] for k in held], [k[1] for k in held], list(held.values())))
        yield pd.DataFrame({"ns": rows["ns"], "op_id": rows["op_id"], "attempt": rows["attempt"], "outcome": out})

    # Keys as text: a missing one stays missing, and long ones whole.
    named = submissions.select(F.col("ns").cast("string"), F.col("op_id").cast("string"), "attempt", "digest", F.pmod(F.xxhash64("ns", "op_id"), F.lit(LOTS)).alias("lot"))
    shape = "ns array<string>, ops array<string>, digests array<string>"
    found = named.groupBy("lot").applyInPandasWithState(judge, "ns string, op_id string, attempt int, outcome string", shape, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("ns").cast("long"), F.col("op_id").cast("long"), "attempt", "outcome")


def sequence_check(log: DataFrame) -> DataFrame:
    """(ns, seq, problem): gaps and broken chains of each namespace as its events come, batch by batch in the order of their sequences.
    State: the last sequence and digest."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, digest = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for s, d, p in zip(rows["seq"], rows["digest"], rows["prev_digest"]):
            p = p if isinstance(p, str) else None
            if s != seq + 1:
                out.append((key[0], s, "gap"))
            elif p != digest:
                out.append((key[0], s, "chain"))
            seq, digest = int(s), d
        state.update((seq, digest))
        yield pd.DataFrame(out, columns=["ns", "seq", "problem"])

    return log.groupBy("ns").applyInPandasWithState(check, "ns long, seq long, problem string", "seq long, digest string", "append", GroupStateTimeout.NoTimeout)


def staging(events: DataFrame, quota: int = 1 << 16) -> DataFrame:
    """(session, seq, outcome, state, chunks): as log.staging_steps, steps of a session in the order of their sequences over all batches.
    State: where the session stands and its chunks' digests, `quota` at most."""
    from ..operators.log import staged

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: dict = {}
        if state.exists:
            name, total, ts, have, digests = state.get
            now = {"state": name, "chunks": total, "ts": ts, "have": dict(zip(have, digests))}
        rows = pd.concat(list(batches)).sort_values("seq")
        rows = rows.astype(object).where(rows.notna(), None)
        out = []
        for seq, kind, chunk, digest, ts, total in zip(*(rows[c] for c in ("seq", "kind", "chunk", "digest", "ts_us", "total"))):
            outcome = staged(now, kind, None if chunk is None else int(chunk), digest, ts, total, quota)
            out.append((key[0], seq, outcome, now.get("state"), len(now.get("have", ()))))
        if now:
            state.update((now["state"], now["chunks"], now["ts"], list(now["have"]), list(now["have"].values())))
        yield pd.DataFrame(out, columns=["session", "seq", "outcome", "state", "chunks"])

    shape = "state string, total long, ts long, have array<long>, digests array<string>"
    return events.groupBy("session").applyInPandasWithState(step, "session long, seq long, outcome string, state string, chunks long", shape, "append", GroupStateTimeout.NoTimeout)


def mirror(remote_updates: DataFrame, pass_once: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that runs a mirror's pass (operators.mirror.sync) for each batch of a stream of remote reference updates."""
    return remote_updates.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(pass_once).start()


def replay(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], order: str, batches: int = 3) -> DataFrame:
    """What a streaming operator makes of rows, read as a stream of so many batches, cut by ranges of `order`. All tables lie in the shared folder."""
    from ..operators.graph import _folder, _written

    spark = rows.sparkSession
    held = _written(rows)
    cuts = held.agg(F.percentile_approx(order, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    path, out, state = (_folder(spark) for _ in range(3))
    lower = None
    # A file a batch, written one after the other: a stream of files takes them by their time.
    for upper in [*sorted(set(cuts)), None]:
        part = held if lower is None else held.where(F.col(order) > lower)
        part = part if upper is None else part.where(F.col(order) <= upper)
        part.coalesce(1).write.mode("append").parquet(path)
        lower = upper
    stream = operator(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
