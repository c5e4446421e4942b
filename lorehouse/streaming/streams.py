"""Structured Streaming: ingestion, sessions, deduplication, tiered consolidation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import nearest_in_group
from ..operators.text import minimize, redact

# Fixed values.
TURN_CHARS, SESSION_CHARS = 1_600, 48_000
LEAST_SUBSTANCE = 64
NOOP, DUPLICATE = 0.95, 0.92
# End of the fixed values.


def dedup_stream(stream: DataFrame, keys: list[str], time: str, ttl: str = "24 hours") -> DataFrame:
    """Drops repeats within the watermark; the horizon is fixed at the first row."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def dedup_sliding(stream: DataFrame, key: str, time: str, ttl_seconds: int = 86_400) -> DataFrame:
    """(key, time) of rows with no row of their key in the TTL before them; a repeat starts the TTL anew."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # Within a span as long as the TTL every row but the first repeats the one before it: two times a span are all that is held.
        spans: dict[int, tuple[int, int]] = {}
        for b in batches:
            us = b[time].to_numpy().astype("datetime64[us]").astype("int64")
            for span, part in pd.Series(us).groupby(us // (ttl_seconds * 1_000_000)):
                low, high = spans.get(span, (part.iloc[0], part.iloc[0]))
                spans[span] = min(low, int(part.min())), max(high, int(part.max()))
        out = []
        for span in sorted(spans):
            low, high = spans[span]
            if last is None or low / 1e6 - last > ttl_seconds:
                out.append(low)
            last = max(last or 0.0, high / 1e6)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), time: pd.to_datetime(out, unit="us", utc=True)})

    kind = stream.schema[key].dataType.simpleString()
    late = stream.withWatermark(time, f"{ttl_seconds} seconds").select(key, time)
    return late.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def distilled(turns: Column) -> Column:
    """The transcript of an array of (turn, ts, role, text): turns cut at TURN_CHARS, whole at SESSION_CHARS."""
    role = lambda t: F.when(F.lower(t.role) == "user", "USER").when(F.lower(t.role) == "assistant", "ASSISTANT").otherwise("TURN")
    line = F.transform(F.array_sort(turns), lambda t: F.concat(role(t), F.lit(": "), F.substring(t.text, 1, TURN_CHARS)))
    return F.substring(F.array_join(line, "\n"), 1, SESSION_CHARS)


def session_distill(stream: DataFrame, idle: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """stream (session_id, turn, role, text, ts): one transcript for each session that has been idle, in append mode."""
    s = stream.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", idle))
    return s.agg(F.count("*").alias("turns"), distilled(F.collect_list(F.struct("turn", "ts", "role", F.substring("text", 1, TURN_CHARS).alias("text")))).alias("transcript")).select("session_id", "turns", "transcript")


def prepare_records(records: DataFrame, allowed: list[str]) -> DataFrame:
    """records (source, record, version, body, meta): metadata cut down, the body redacted, thin ones left out."""
    slim = minimize(records.select(F.struct("source", "record", "version").alias("id"), "meta"), allowed)
    kept = records.select(F.struct("source", "record", "version").alias("id"), redact(F.col("body")).alias("body")).where(F.char_length(F.trim("body")) >= LEAST_SUBSTANCE)
    return kept.join(slim, "id").select("id.*", "body", "meta", "trail")


#: Parts of a sink, by the hash of its key: a batch reads those that its rows may be in.
SINK_PARTS = 256


def land_records(stream: DataFrame, allowed: list[str], sink: str, checkpoint: str, mask: Callable[[Column], Column] = redact) -> None:
    """Adds prepared records to a Parquet sink, each (source, record, version) once, however often a batch is run, with the names of what was left out of their metadata. The sink is dealt by key, and a batch reads the keys of its own parts alone."""
    key = ["source", "record", "version"]

    def land(batch: DataFrame, _: int) -> None:
        rows = batch.select(*key, "body", F.map_filter("meta", lambda k, v: k.isin(allowed)).alias("meta"), F.array_sort(F.map_keys(F.map_filter("meta", lambda k, v: ~k.isin(allowed)))).alias("trail"), F.pmod(F.xxhash64(*key), F.lit(SINK_PARTS)).cast("int").alias("part"))
        parts = [r["part"] for r in rows.select("part").distinct().collect()]  # SINK_PARTS at most
        new = rows.join(existing(batch.sparkSession, sink, rows).where(F.col("part").isin(parts)).select(*key), key, "left_anti")
        # Exploded, not filtered: a filter would be pushed below and redact each body once more.
        body = F.filter(F.array(mask(F.col("body"))), lambda b: F.char_length(F.trim(b)) >= LEAST_SUBSTANCE)
        new.select(*key, "part", F.explode(body).alias("body"), "meta", "trail").dropDuplicates(key).write.mode("append").partitionBy("part").parquet(sink)

    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows at path, none if nothing is there yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(like.schema).parquet(path) if there else like.limit(0)


def verdict(sim: Column, floor: float = 0.5) -> Column:
    """NOOP for what is there already, ADD for what is new, NEEDS_REVIEW between."""
    return F.when(sim >= NOOP, "NOOP").when(sim.isNull() | (sim < floor), "ADD").otherwise("NEEDS_REVIEW")


def fact_verdicts(incoming: DataFrame, known: DataFrame, limit: float = DUPLICATE) -> DataFrame:
    """(fact_id, sim, verdict, action) of incoming facts (fact_id, entity_slug, v) by the nearest known one (fact_id, entity_slug, v) of the same entity. Groups are compared in blocks."""
    id_ = F.col("fact_id").alias("id")
    near = nearest_in_group(incoming.select(id_, "entity_slug", "v"), known.select(id_, "entity_slug", "v"), "entity_slug").select(F.col("id").alias("fact_id"), "sim")
    s = incoming.select("fact_id").join(near, "fact_id", "left")
    return s.select("fact_id", F.round("sim", 6).alias("sim"), F.when(F.coalesce("sim", F.lit(0.0)) >= limit, "duplicate").otherwise("independent").alias("verdict"), verdict(F.col("sim")).alias("action"))


def fact_verdict_stream(stream: DataFrame, known: DataFrame, sink: str, checkpoint: str, limit: float = DUPLICATE) -> None:
    """Appends the verdicts of a stream of facts against a static table, batch by batch; a batch that runs again replaces its own rows."""

    def judge(batch: DataFrame, n: int) -> None:
        fact_verdicts(batch, known, limit).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_fact_dedup(stream: DataFrame, limit: float = DUPLICATE, ttl_seconds: int = 7 * 86_400, late: str = "1 hour", claim: str | None = None) -> DataFrame:
    """(fact_id, matched_id, sim, verdict) of a stream (fact_id, entity_slug, v, at): each fact against those of its entity that the stream itself has made known.

    A fact of at least that cosine to one known within the TTL before it is a duplicate
    of the nearest, ties to the one known first; any other is independent and known
    from then on. An entity's state holds its independent facts of the last TTL alone,
    and goes when the watermark has passed them. Facts of a batch come in the order of
    time and id; facts that were known before the stream began are sent through it
    first. A fact without a vector is independent and never matched. Where a column `claim`
    is named, facts repeat that are equal in it instead, whatever their vectors: its values, as text, are what is held.
    """
    micros = ttl_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, times, flat = (list(x) for x in state.get) if state.exists else ([], [], [])
        dim = len(flat) // len(ids) if ids else 0
        known = np.array(flat, dtype=float).reshape(len(ids), dim)
        rows = pd.concat([b[["fact_id", "at", "v"]] for b in batches])
        rows["at"] = rows["at"].to_numpy().astype("datetime64[us]").astype("int64")
        rows = rows.sort_values(["at", "fact_id"], ignore_index=True)
        out, held = [], known.shape[0]
        grown = np.empty((held + len(rows), dim or max((len(v) for v in rows["v"] if v is not None), default=0)))
        if held:
            grown[:held] = known
        for fact, at, v in zip(rows["fact_id"], rows["at"], rows["v"], strict=True):
            if v is None or len(v) != grown.shape[1]:
                out.append((fact, None, None, "independent"))
                continue
            u = np.asarray(v, dtype=float)
            u = u / max(np.sqrt((u**2).sum()), 1e-300)
            sims = np.round(grown[:held] @ u, 9)
            sims[(np.array(times, dtype=np.int64) < at - micros) if held else slice(0)] = -2.0
            best = int(sims.argmax()) if held else -1
            if best >= 0 and sims[best] >= limit:
                out.append((fact, ids[best], round(float(sims[best]), 6), "duplicate"))
                continue
            out.append((fact, None, None, "independent"))
            grown[held] = u
            held += 1
            ids.append(int(fact))
            times.append(int(at))
        newest = int(rows["at"].max())
        keep = [k for k in range(held) if times[k] >= newest - micros]
        state.update(([ids[k] for k in keep], [times[k] for k in keep], grown[keep].ravel().tolist()))
        state.setTimeoutTimestamp(max((newest + micros) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["fact_id", "matched_id", "sim", "verdict"]).astype({"matched_id": "Int64", "sim": "Float64"})

    def by_claim(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, times, claims = state.get if state.exists else ([], [], [])
        known = dict(zip(claims, zip(times, ids, strict=True), strict=True))  # of each claim the one known last: no two lie within a TTL
        rows = pd.concat([b[["fact_id", "at", "claim"]] for b in batches])
        rows["at"] = rows["at"].to_numpy().astype("datetime64[us]").astype("int64")
        rows = rows.sort_values(["at", "fact_id"], ignore_index=True)
        out = []
        for fact, at, said in zip(rows["fact_id"].tolist(), rows["at"].tolist(), rows["claim"], strict=True):
            before = known.get(said) if said is not None else None
            if before and before[0] >= at - micros:
                out.append((fact, before[1], 1.0, "duplicate"))
                continue
            out.append((fact, None, None, "independent"))
            if said is not None:
                known[said] = (at, fact)
        newest = int(rows["at"].max())
        keep = [(c, t, i) for c, (t, i) in known.items() if t >= newest - micros]
        state.update(([i for _, _, i in keep], [t for _, t, _ in keep], [c for c, _, _ in keep]))
        state.setTimeoutTimestamp(max((newest + micros) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["fact_id", "matched_id", "sim", "verdict"]).astype({"matched_id": "Int64", "sim": "Float64"})

    v = F.col(claim).cast("string").alias("claim") if claim else F.col("v").cast("array<double>").alias("v")
    rows = stream.withWatermark("at", late).select("fact_id", "entity_slug", v, "at")
    schema = "fact_id bigint, matched_id bigint, sim double, verdict string"
    held = "claims array<string>" if claim else "vectors array<double>"
    return rows.groupBy("entity_slug").applyInPandasWithState(by_claim if claim else step, schema, f"ids array<bigint>, times array<bigint>, {held}", "append", GroupStateTimeout.EventTimeTimeout)


def expired(candidates: DataFrame, now: Column, live: tuple[str, ...] = ("pending",)) -> tuple[DataFrame, DataFrame]:
    """Candidates (status, expires_at, ...) that stay, and those that go: still `live` at the time their expires_at has come. No expires_at is no end, and what was decided stays."""
    over = F.col("status").isin(*live) & F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return candidates.where(~F.coalesce(over, F.lit(False))), candidates.where(F.coalesce(over, F.lit(False)))


def activity_counts(stream: DataFrame, days: int = 1, late: str = "2 days") -> DataFrame:
    """(start, cohort, n, users) of a stream (at, cohort, who): events and about how many different ones by window of so many days, one a day. Late rows still count until the watermark has passed their window; in update mode."""
    span = F.window("at", "1 day") if days == 1 else F.window("at", f"{days} days", "1 day")
    s = stream.withWatermark("at", late).groupBy(span, "cohort").agg(F.count("*").alias("n"), F.approx_count_distinct("who").alias("users"))
    return s.select(F.col("window.start").alias("start"), "cohort", "n", "users")


def telemetry_rollup(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, mode, intent, calls, results, tokens, dropped) of a stream (at, mode, intent, results, tokens, dropped): sums by day that later rows add to, from which averages are taken when read; in update mode."""
    s = stream.withWatermark("at", late).groupBy(F.window("at", "1 day"), "mode", "intent")
    s = s.agg(F.count("*").alias("calls"), F.sum("results").alias("results"), F.sum("tokens").alias("tokens"), F.sum("dropped").alias("dropped"))
    return s.select(F.to_date("window.start").alias("day"), "mode", "intent", "calls", "results", "tokens", "dropped")


def upsert_latest(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream of updates over all there is and gives the last state of each key: every batch is written under its number, and the latest row of a key is the one that counts."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/part={n}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.parquet(f"{folder}/out").drop("part")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def incremental(df: DataFrame, watermark: Column | None, time: str, slug: Column | None = None, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows newer than the watermark, oldest first, and the new watermark as one row."""
    new = df if watermark is None else df.where(F.col(time) > watermark)
    new = new if prefix is None else new.where(slug.startswith(prefix))
    return new.orderBy(time), new.agg(F.max(time).alias("watermark"))


def run_once(stream: DataFrame, name_dir: str, mode: str = "append", each: Callable | None = None) -> str:
    """Runs a stream over all there is and returns the Parquet folder that it wrote."""
    out = f"{name_dir}/out"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{name_dir}/checkpoint").trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out
