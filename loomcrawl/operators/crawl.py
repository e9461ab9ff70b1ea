"""Politeness and sharding over crawl events (domain, ts, ok, seconds, id), as windows and ordered folds."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, LEAST, MOST, AFTER = 1.0, 0.5, 10.0, 10


def minute(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 60)


def bucket(ts: Column, seconds: int = 30) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds)


def gaps(events: DataFrame) -> DataFrame:
    """Seconds since the domain's event before."""
    before = F.lag("ts").over(Window.partitionBy("domain").orderBy("ts", "id"))
    return events.withColumn("gap", F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(before.cast("timestamp")))


def over_rate(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Events that come after `limit` others of their domain in one tumbling window."""
    place = F.row_number().over(Window.partitionBy("domain", "w").orderBy("ts", "id"))
    return events.withColumn("w", bucket(F.col("ts"), seconds)).withColumn("n", place).where(F.col("n") > limit)


def micros(seconds: Column) -> Column:
    """Seconds as whole microseconds, negative ones and nulls as none."""
    return F.round(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) * 1_000_000).cast("long")


def mean_seconds(total: Column, n: Column) -> Column:
    """The mean of whole microseconds, rounded half up in whole numbers, in seconds: no order of addition changes it."""
    return F.floor((total * 2 + n) / (n * 2)).cast("double") / 1_000_000


def running(events: DataFrame) -> DataFrame:
    """Requests, successes and mean response time of the domain so far, the event included."""
    w = Window.partitionBy("domain").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(w)
    return events.select("domain", "id", n.alias("requests"), F.sum(F.col("ok").cast("int")).over(w).alias("successes"), mean_seconds(F.sum(micros(F.col("seconds"))).over(w), n).alias("avg_response"))


def adaptive_delay(events: DataFrame) -> DataFrame:
    """The delay that each domain has come to: longer after failures or slow answers, shorter after fast successes.

    From the AFTER-th request on: under 80 % success or over 5 s on average: 1.5 times, MOST at most; over 95 % and
    under 1 s: 0.8 times, LEAST at least. An ordered fold; a domain's history is one array of small structs.
    """
    steps = F.array_sort(F.collect_list(F.struct("ts", "id", F.col("ok").cast("int").alias("ok"), "seconds")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("good"), F.lit(0.0).alias("avg"), F.lit(START).alias("delay"))

    def step(z: Column, x: Column) -> Column:
        n, good = z["n"] + 1, z["good"] + x["ok"]
        avg = F.when(x["seconds"] > 0, (z["avg"] * (n - 1) + x["seconds"]) / n).otherwise(z["avg"])
        share = good / n
        delay = F.when(n < AFTER, z["delay"]).when((share < 0.8) | (avg > 5), F.least(z["delay"] * 1.5, F.lit(MOST))).when((share > 0.95) & (avg < 1), F.greatest(z["delay"] * 0.8, F.lit(LEAST))).otherwise(z["delay"])
        return F.struct(n.alias("n"), good.alias("good"), avg.alias("avg"), delay.alias("delay"))

    return events.groupBy("domain").agg(steps.alias("s")).select("domain", F.aggregate("s", zero, step).alias("z")).select("domain", F.col("z.n").alias("requests"), F.round("z.avg", 6).alias("avg_response"), F.round("z.delay", 6).alias("delay"))


def robots_allowed(requests: DataFrame, agent: str = "*") -> DataFrame:
    """requests(domain, url, robots_txt) with `allowed`; a null robots_txt allows all. Each distinct file is parsed once a batch."""

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, robots: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, r in zip(url, robots, strict=True):
            if r is None:
                out.append(True)
                continue
            if r not in parsers:
                parsers[r] = RobotFileParser()
                parsers[r].parse(r.splitlines())
            out.append(parsers[r].can_fetch(agent, u))
        return pd.Series(out, dtype=bool)

    return requests.withColumn("allowed", allowed("url", "robots_txt"))


def gate(events: DataFrame, delay: float = 1.0, per_minute: int = 60) -> DataFrame:
    """Verdict of each request in turn: robots, then crawl delay, then rate: ok, reason, wait in seconds."""
    d = gaps(events)
    place = F.row_number().over(Window.partitionBy("domain", minute(F.col("ts"))).orderBy("ts", "id")) - 1
    reason = F.when(~F.coalesce("allowed", F.lit(True)), "robots").when(F.col("gap") < delay, "crawl_delay").when(place >= per_minute, "rate_limit")
    wait = F.when(reason == "crawl_delay", delay - F.col("gap")).when(reason == "rate_limit", 10.0).otherwise(0.0)
    return (d if "allowed" in d.columns else d.withColumn("allowed", F.lit(True))).withColumn("reason", reason).withColumn("wait", wait).withColumn("ok", reason.isNull())


def shard_loads(assigned: DataFrame) -> DataFrame:
    """Assignments of each shard (0..n-1) and minute."""
    return assigned.groupBy("shard", minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("n"))


def distribution(assigned: DataFrame) -> DataFrame:
    loads = assigned.groupBy("shard").agg(F.count("*").alias("n"))
    total = loads.agg(F.sum("n").alias("total"))  # one row
    return loads.crossJoin(F.broadcast(total)).select("shard", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))


def imbalance(assigned: DataFrame) -> DataFrame:
    """Loads of the shards compared; over_loaded and under_loaded count those above 1.5 and below 0.5 of the mean.

    The array holds a number a shard, and their number is fixed.
    """
    loads = assigned.groupBy("shard").agg(F.count("*").alias("n"))
    s = loads.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.collect_list("n").alias("loads"))
    beside = [F.size(F.filter("loads", lambda n: n > 1.5 * F.col("mean"))).cast("long").alias("over_loaded"), F.size(F.filter("loads", lambda n: n < 0.5 * F.col("mean"))).cast("long").alias("under_loaded")]
    return s.select("most", "least", F.round("mean", 6).alias("mean"), F.round(F.col("most") / F.greatest("least", F.lit(1)), 6).alias("ratio"), (F.col("most") / F.greatest("least", F.lit(1)) >= 2).alias("act"), *beside)


def verdicts(gated: DataFrame, limit: int = 100, wait: float = 30.0) -> DataFrame:
    """Rows of gate with a shard as status scheduled, delayed, rejected (robots) or error (no domain), and their wait.

    A request that the gate lets through waits `wait` seconds if its shard has `limit` such requests in that minute.
    """
    place = F.row_number().over(Window.partitionBy("shard", minute(F.col("ts")), "ok").orderBy("ts", "id"))
    full = F.col("ok") & (place > limit)
    status = F.when(F.col("domain").isNull(), "error").when(F.col("reason") == "robots", "rejected").when(~F.col("ok") | full, "delayed").otherwise("scheduled")
    return gated.withColumn("status", status).withColumn("wait", F.when(full, wait).otherwise(F.col("wait")))


def service_means(events: DataFrame, by: str) -> DataFrame:
    """Requests, successes and mean seconds of each group, exact in any order of addition."""
    return events.groupBy(by).agg(F.count("*").alias("requests"), F.count_if("ok").alias("successes"), mean_seconds(F.sum(micros(F.col("seconds"))), F.count("*")).alias("avg_response"))


def overloaded(assigned: DataFrame, limit: int = 100) -> DataFrame:
    """Assignments beyond `limit` of their shard and minute; they would wait 30 s or move to the least loaded shard."""
    place = F.row_number().over(Window.partitionBy("shard", minute(F.col("ts"))).orderBy("ts", "id"))
    return assigned.withColumn("place", place).where(F.col("place") > limit)


def recommended_fetchers(n: Column) -> Column:
    return F.least(F.lit(16), F.greatest(F.lit(1), F.ceil(n / 100))).cast("int")


def load_balanced(events: DataFrame, shards: int = 4) -> DataFrame:
    """Each event to the shard with the least events of its minute, the lowest number first of equals.

    Loads begin at nothing each minute, so arrivals in turn fill the shards in turn: one window a minute, no fold.
    """
    place = F.row_number().over(Window.partitionBy(minute(F.col("ts"))).orderBy("ts", "id")) - 1
    return events.withColumn("shard", (place % shards).cast("int"))


def sticky(events: DataFrame, shards: int = 4, ttl: int = 3600) -> DataFrame:
    """A domain keeps one shard within each tumbling window of ttl seconds (its lease).

    Leases that begin in one minute are dealt to the shards in turn. They are a map-side combined aggregate, so a
    domain with many events is one small row before anything is ordered.
    """
    lease = events.groupBy("domain", bucket(F.col("ts"), ttl).alias("lease")).agg(F.min(F.struct("ts", "id")).alias("first"))
    place = F.row_number().over(Window.partitionBy(minute(F.col("first.ts"))).orderBy("first", "domain")) - 1
    dealt = lease.select("domain", "lease", (place % shards).cast("int").alias("shard"))
    return events.drop("shard").withColumn("lease", bucket(F.col("ts"), ttl)).join(dealt, ["domain", "lease"]).drop("lease")


def last_shards(assigned: DataFrame) -> DataFrame:
    """domain, shard: where each domain was sent last."""
    return assigned.groupBy("domain").agg(F.max_by("shard", F.struct("ts", "id")).alias("shard"))


def rebalance(assigned: DataFrame, each: int = 2) -> DataFrame:
    """domain, from_shard, to_shard: `each` domains at most of every shard above 1.5 times the mean load go to shards
    below half of it, each of which takes one; nothing while the greatest load is under twice the least.

    Domains move in their own order. Both numbered lists have rows for shards only, whatever the number of events.
    """
    loads = assigned.groupBy("shard").agg(F.count("*").alias("n"))
    s = loads.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean")).where("most >= 2 * greatest(least, 1)")
    judged = loads.crossJoin(F.broadcast(s))  # one row
    of_shard = Window.partitionBy("shard").orderBy("domain")
    over = last_shards(assigned).join(F.broadcast(judged.where("n > 1.5 * mean").select("shard")), "shard").withColumn("k", F.row_number().over(of_shard)).where(F.col("k") <= each)
    moves = over.select("domain", F.col("shard").alias("from_shard"), F.row_number().over(Window.orderBy("shard", "domain")).alias("slot"))
    room = judged.where("n < 0.5 * mean").select(F.col("shard").alias("to_shard"), F.row_number().over(Window.orderBy("shard")).alias("slot"))
    return moves.join(room, "slot").drop("slot")


def relieved(assigned: DataFrame, limit: int = 100, shards: int = 4, wait: float = 30.0) -> DataFrame:
    """Assignments beyond `limit` of their shard and minute with to_shard, the least loaded shard of that minute that
    is under the limit (lowest number of equals); without one they wait. Loads are those before anything moves."""
    over = overloaded(assigned, limit).withColumn("minute", minute(F.col("ts")))
    loads = assigned.groupBy(minute(F.col("ts")).alias("minute")).agg(*[F.count_if(F.col("shard") == k).alias(f"n{k}") for k in range(shards)])
    free = F.array_min(F.filter(F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("shard")) for k in range(shards)]), lambda x: x["n"] < limit))
    return over.join(loads.select("minute", free["shard"].alias("to_shard")), "minute").drop("minute").withColumn("wait", F.when(F.col("to_shard").isNull(), wait).otherwise(0.0))


def over_concurrency(events: DataFrame, limit: int = 2, ttl: int | None = 300) -> DataFrame:
    """Events (with `seconds` of work) that begin while `limit` or more of their domain are running.

    A crawl runs until ts + seconds, ttl seconds at most; one that ends as another begins has ended.
    """
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    work = F.round(F.coalesce(F.col("seconds"), F.lit(0.0)) * 1e6).cast("long")
    d = events.select("domain", "id", start.alias("at"), (F.least(work, F.lit(ttl * 1_000_000)) if ttl else work).alias("work"))
    steps = d.select("domain", "id", "at", F.lit(1).alias("step")).unionByName(d.select("domain", "id", (F.col("at") + F.col("work")).alias("at"), F.lit(-1).alias("step")))
    w = Window.partitionBy("domain").orderBy("at", "step", "id").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("running", F.coalesce(F.sum("step").over(w), F.lit(0))).where((F.col("step") == 1) & (F.col("running") >= limit)).select("domain", "id", "running")


def ready(queue: DataFrame, now: Column, most: int = 100, attempts: int = 5, seconds: int = 30) -> DataFrame:
    """Delayed items (id, ready_at, scheduled_at, attempts) that are due: earlier buckets first, newest first inside one.

    Items tried more than `attempts` times are given up; however old, none is lost.
    """
    due = queue.where((F.col("ready_at") <= now) & (F.col("attempts") <= attempts))
    return due.withColumn("bucket", bucket(F.col("ready_at"), seconds)).orderBy("bucket", F.col("scheduled_at").desc(), "id").limit(most)


def queue_counts(queue: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """Items and non-empty buckets among the ten buckets before now's and the ten from it on."""
    here = F.floor(F.unix_timestamp(now.cast("timestamp")) / seconds)
    near = queue.select(bucket(F.col("ready_at"), seconds).alias("bucket")).where(F.col("bucket").between(here - 10, here + 9))
    return near.agg(F.count("*").alias("items"), F.countDistinct("bucket").alias("buckets"))
