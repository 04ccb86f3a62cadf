"""Process and system operators: file-open deduplication, rate limit, tracking, lifetimes, CPU shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import payload as P
from traceloom.operators.trees import climbed, linked
from traceloom.store import write_table

WINDOW_NS = 60_000_000_000


def dedup_opens(opens: DataFrame, by: list[str] | None = None, time: str = "timestamp_ns", gap: int = WINDOW_NS) -> DataFrame:
    """Opens of one file by one process, a row for each run whose pauses are `gap` at most: first, last, count."""
    by = by or ["pid", "filepath"]
    order = Window.partitionBy(*by).orderBy(time)
    new = F.coalesce(F.col(time) - F.lag(time).over(order) > gap, F.lit(True))
    runs = opens.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "__run").agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("count")).drop("__run")


def opens_by_process(opens: DataFrame, exits: DataFrame, by: list[str], path: str = "filepath", time: str = "timestamp_ns", gap: int = WINDOW_NS) -> DataFrame:
    """Runs of opens as dedup_opens gives them, that end with their process too, and why each ended: process_exit
    where an EXIT comes before the pause is over, else window_expired. exits: (*by, time)."""
    both = opens.select(*by, time, path, F.lit(0).alias("__exit")).unionByName(exits.select(*by, time, F.lit(None).cast("string").alias(path), F.lit(1).alias("__exit")))
    order = Window.partitionBy(*by).orderBy(time, "__exit")
    life = F.sum("__exit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = F.first(F.when(F.col("__exit") == 1, F.col(time)), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    lives = both.withColumn("__life", F.coalesce(life, F.lit(0))).withColumn("__ends", ends).where("__exit = 0")
    order = Window.partitionBy(*by, path, "__life").orderBy(time)
    new = F.coalesce(F.col(time) - F.lag(time).over(order) > gap, F.lit(True))
    runs = lives.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, path, "__life", "__run").agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("count"), F.min("__ends").alias("__ends"))
    reason = F.when(F.col("__ends") - F.col("last_seen") <= gap, "process_exit").otherwise("window_expired")
    return out.withColumn("reason", reason).drop("__life", "__run", "__ends")


def without_thread_exits(events: DataFrame) -> DataFrame:
    """EXITs that name a thread other than the process's first one are ends of threads, and go."""
    v = P.parsed()
    of_thread = (F.col("source") == "process") & (P.text(v, "$.event") == "EXIT") & (P.integer(v, "$.tid") != F.col("pid"))
    return events.where(~F.coalesce(of_thread, F.lit(False)))


def exit_warnings(events: DataFrame, exits: DataFrame, second: Column, by: list[str], time: str, most: int = 30) -> DataFrame:
    """exits with rate_limit_warning: the last active second of the process before it had over `most` events. A pid that
    is used again starts anew, as no second from before the EXIT before counts."""
    per = events.withColumn("__s", second).groupBy(*by, "__s").agg(F.count("*").alias("__n"), F.max(time).alias(time))
    names = [c for c in exits.columns if c not in (*by, time)]
    both = per.select(*by, time, (F.col("__n") > most).alias("__over"), *(F.lit(None).cast(exits.schema[c].dataType).alias(c) for c in names)).unionByName(exits.select(*by, time, F.lit(None).cast("boolean").alias("__over"), *names))
    order = Window.partitionBy(*by).orderBy(time, F.col("__over").isNull())
    before = F.lag("__over").over(order)
    return both.withColumn("rate_limit_warning", F.coalesce(before, F.lit(False))).where("__over IS NULL").select(*exits.columns, "rate_limit_warning")


def rate_limit(events: DataFrame, second: Column, by: list[str], order: list[str], most: int = 30) -> DataFrame:
    """The first `most` events of each second of a process. A row has rate_limit_warning if it is the first of its
    second and the process's last active second had more."""
    e = events.withColumn("__s", second)
    place = Window.partitionBy(*by, "__s").orderBy(*order)
    ranked = e.withColumn("__n", F.row_number().over(place))
    per = ranked.groupBy(*by, "__s").agg(F.count("*").alias("__c"))
    per = per.withColumn("__over", F.coalesce(F.lag("__c").over(Window.partitionBy(*by).orderBy("__s")) > most, F.lit(False))).drop("__c")
    kept = ranked.where(F.col("__n") <= most).join(per, [*by, "__s"])
    return kept.withColumn("rate_limit_warning", F.col("__over") & (F.col("__n") == 1)).drop("__n", "__over").withColumnRenamed("__s", "second")


def lifetimes(process: DataFrame) -> DataFrame:
    """EXITs with the time of the last EXEC of their pid before them, and the milliseconds between."""
    order = Window.partitionBy("session_id", "pid").orderBy("event_time", "id").rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col("event_type") == "EXEC", F.col("event_time")), ignorenulls=True).over(order)
    rows = process.where(F.col("event_type").isin("EXEC", "EXIT")).withColumn("exec_time", began).where("event_type = 'EXIT'")
    ms = F.unix_millis(F.col("event_time").cast("timestamp")) - F.unix_millis(F.col("exec_time").cast("timestamp"))
    return rows.select("session_id", "pid", "exec_time", F.col("event_time").alias("exit_time"), "exit_code", ms.alias("lifetime_ms"))


def cpu_percent(samples: DataFrame, by: list[str], time_s: Column, jiffies: str, hz: int = 100) -> DataFrame:
    """Percent of a CPU since the sample before; 0 for the first and where time stands still."""
    s = samples.withColumn("__t", time_s)
    order = Window.partitionBy(*by).orderBy("__t", jiffies)
    dt, dj = F.col("__t") - F.lag("__t").over(order), F.col(jiffies) - F.lag(jiffies).over(order)
    return s.withColumn("cpu_percent", F.coalesce(F.when(dt > 0, dj / hz / dt * 100), F.lit(0.0))).drop("__t")


def with_children(samples: DataFrame, processes: DataFrame) -> DataFrame:
    """Resident memory of each process with all below it, where any of those has a sample. processes: (session_id, pid, ppid);
    samples: (session_id, pid, mem_rss_kb). Sums climb the tree by doubling; links along a circle of parents don't count."""
    own = samples.groupBy("session_id", "pid").agg(F.sum("mem_rss_kb").alias("mem_rss_kb"), F.count("*").alias("processes"))
    links = linked(processes.join(own, ["session_id", "pid"], "left"), ["session_id"], keep=("mem_rss_kb", "processes"))
    found = climbed(links, ["session_id"], {"mem_rss_kb": "sum", "processes": "sum"}).where("processes IS NOT NULL")
    return found.select("session_id", F.col("node").alias("pid"), "mem_rss_kb", "processes")


def lives(events: DataFrame) -> DataFrame:
    """Process events with life: how many EXITs of their pid came before. An EXIT belongs to the life that it ends."""
    order = Window.partitionBy("session_id", "pid").orderBy("timestamp_ns", "stream_seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("life", F.coalesce(F.sum((F.col("__kind") == "EXIT").cast("int")).over(order), F.lit(0)))


def tracked_lives(events: DataFrame, hit: Column, seeds: DataFrame | None = None) -> DataFrame:
    """(session_id, pid, life, since): lives that are tracked, from when on.

    A life is tracked from its first event for which `hit` holds, or its first EXEC whose parent is tracked by then;
    processes of seeds (session_id, pid) from the beginning of their first life. An edge says: if the parent is
    tracked by `need`, the child is from `give` on. Round k holds the edges of exactly 2^k steps, about one for each EXEC,
    and ends when it reaches nothing new or earlier: what a longer path reaches first, a path of 2^k to 2^(k+1) steps would
    have, too. So chains of any depth end after a logarithmic number of rounds, and cycles end too.
    """
    e = write_table(lives(events), "lives")
    node = lambda pid, life: F.struct(F.col(pid).alias("pid"), F.col(life).alias("life"))
    born = e.where("__kind = 'EXEC' AND ppid IS NOT NULL").select("session_id", "timestamp_ns", "stream_seq", "ppid", node("pid", "life").alias("c"))
    # the life of the parent at that time: the EXITs of the parent's pid before
    exits = e.where("__kind = 'EXIT'").select("session_id", F.col("pid").alias("ppid"), "timestamp_ns", "stream_seq", F.lit(None).cast("struct<pid:bigint,life:bigint>").alias("c"))
    order = Window.partitionBy("session_id", "ppid").orderBy("timestamp_ns", "stream_seq").rowsBetween(Window.unboundedPreceding, -1)
    edges = born.unionByName(exits).withColumn("n", F.coalesce(F.sum(F.col("c").isNull().cast("int")).over(order), F.lit(0))).where("c IS NOT NULL")
    edges = edges.select("session_id", node("ppid", "n").alias("a"), "c", F.col("timestamp_ns").alias("need"), F.col("timestamp_ns").alias("give")).where("a <> c").distinct()
    first = e.where(hit).groupBy("session_id", node("pid", "life").alias("c")).agg(F.min("timestamp_ns").alias("since"))
    if seeds is not None:
        zero = F.struct("pid", F.lit(0).cast("bigint").alias("life")).alias("c")
        first = first.unionByName(seeds.select("session_id", zero, F.lit(-(1 << 62)).alias("since")))
    least = lambda df: df.groupBy("session_id", "c").agg(F.min("since").alias("since"))
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.col("since").cast("decimal(38,0)"))).first())
    reached, jump, before = write_table(least(first), "tracked"), write_table(edges, "edges"), None
    while (now := mark(reached)) != before and now[0]:
        before = now
        for _ in range(2):
            met = reached.withColumnRenamed("c", "a").join(jump, ["session_id", "a"]).where("since <= need").select("session_id", "c", F.col("give").alias("since"))
            reached = least(reached.unionByName(met))
            next_ = jump.select("session_id", F.col("a").alias("c"), F.col("c").alias("__c"), F.col("need").alias("__need"), F.col("give").alias("__give"))
            longer = jump.join(next_, ["session_id", "c"]).where("give <= __need").select("session_id", "a", F.col("__c").alias("c"), "need", F.col("__give").alias("give")).where("a <> c")
            # of the edges with one need the earliest gain, and of those with one gain the latest need
            jump = longer.groupBy("session_id", "a", "c", "need").agg(F.min("give").alias("give")).groupBy("session_id", "a", "c", "give").agg(F.max("need").alias("need"))
        reached, jump = write_table(reached, "tracked"), write_table(jump, "edges")
    return reached.select("session_id", "c.pid", "c.life", "since")


def track(events: DataFrame, mode: int = 0, comms: list[str] | None = None, pids: list[int] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Process events by tracking mode: 0 all; 1 all processes, and the files, network and credentials of tracked ones;
    2 tracked ones only. Tracked are the given pids, processes with a given name, those of seeds (session_id, pid; they ran
    before the log), and what a tracked process starts, from then until its EXIT: a pid that is used again
    is another process. Names, pids or seeds turn mode 0 into 2. `session_id` separates logs, if there is one."""
    comms, pids = comms or [], pids or []
    mode = 2 if mode == 0 and (comms or pids or seeds is not None) else mode
    if mode == 0:
        return events
    e = events if "session_id" in events.columns else events.withColumn("session_id", F.lit(""))
    v = P.parsed()
    kind = F.coalesce(P.text(v, "$.event"), F.lit(""))
    e = e.withColumn("__kind", kind).withColumn("ppid", P.integer(v, "$.ppid"))
    hit = F.col("pid").isin(pids) if pids else F.lit(False)
    hit = hit | F.col("comm").isin(comms) if comms else hit
    own, others = lives(e.where("source = 'process'")), e.where(F.coalesce(F.col("source") != "process", F.lit(True)))
    found = tracked_lives(e.where("source = 'process'").select("session_id", "pid", "comm", "timestamp_ns", "stream_seq", "__kind", "ppid"), hit, seeds)
    marked = own.join(found, ["session_id", "pid", "life"], "left")
    free = F.col("__kind").isin("EXEC", "EXIT", "BASH_READLINE") if mode == 1 else F.lit(False)
    kept = marked.where(free | F.coalesce(F.col("timestamp_ns") >= F.col("since"), F.lit(False)))
    return kept.select(*events.columns).unionByName(others.select(*events.columns))


def pair_syscalls(calls: DataFrame) -> DataFrame:
    """Exits of system calls with the time since the entry of their thread just before: latency_ms. calls: (tid, phase enter|exit, timestamp_ns, ...)."""
    order = Window.partitionBy("tid").orderBy("timestamp_ns")
    began = F.when(F.lag("phase").over(order) == "enter", F.lag("timestamp_ns").over(order))
    return calls.withColumn("__began", began).where("phase = 'exit' AND __began IS NOT NULL").withColumn("latency_ms", (F.col("timestamp_ns") - F.col("__began")) / 1e6).drop("__began")
