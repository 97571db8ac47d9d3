"""Replication and cluster analytics over acknowledgements, votes, logs and heartbeats."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators import maintenance


def acknowledged(indexes: DataFrame, acks: DataFrame, quorum: int) -> DataFrame:
    """Per log index: how many peers (peer_id, match_index) reached it, and whether that is a quorum."""
    # peers are few: their match indexes fold into one sorted array, so log rows need no join
    peers = acks.groupBy("peer_id").agg(F.max("match_index").alias("m")).agg(F.collect_list("m").alias("ms"))
    n = F.size(F.filter("ms", lambda m: m >= F.col("log_index"))).cast("bigint")
    return indexes.crossJoin(F.broadcast(peers)).select("log_index", n.alias("n_acks"), (n >= quorum).alias("committed"))


def wait_for(acks: DataFrame, index: int, replicas: int) -> DataFrame:
    """(count, ok): peers at or past index, and whether they suffice."""
    peers = acks.groupBy("peer_id").agg(F.max("match_index").alias("m"))
    n = F.count_if(F.col("m") >= index)
    return peers.agg(n.alias("n_acks"), (n >= replicas).alias("ok"))


def await_replicas(acks: Callable[[], DataFrame], index: int, replicas: int, timeout: float = 5.0, pause: float = 0.05) -> int:
    """Ask acks() until so many peers have reached the index; how many have. Raises TimeoutError."""
    end = time.monotonic() + timeout
    while True:
        found = wait_for(acks(), index, replicas).first()
        if found.ok:
            return found.n_acks
        if time.monotonic() >= end:
            raise TimeoutError(f"{found.n_acks} of {replicas} replicas reached {index}")
        time.sleep(pause)


def commit_index(acks: DataFrame, current_term: int | DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """majority_index (greatest index that a majority of peers reached) and all_index (least match). With a log, the majority index
    counts only when its entry is of the current term; of a table of terms (current) each is asked."""
    peers = acks.groupBy("peer_id").agg(F.max("match_index").alias("m")).agg(F.sort_array(F.collect_list("m"), asc=False).alias("ms"))
    majority = F.get("ms", F.floor(F.size("ms") / 2).cast("int"))
    out = peers.select(majority.alias("majority_index"), F.array_min("ms").alias("all_index"))
    if current_term is None or log is None:
        return out
    asked = out.crossJoin(F.broadcast(current_term)) if isinstance(current_term, DataFrame) else out.withColumn("current", F.lit(current_term))
    terms = log.select(F.col("log_index").alias("majority_index"), "term")
    return asked.join(terms, "majority_index", "left").select("majority_index", "all_index", F.coalesce(F.col("term") == F.col("current"), F.lit(False)).alias("commits"))


def elect(candidates: DataFrame, cluster: str, candidate: str, last_index: str) -> DataFrame:
    """Per cluster the candidate whose log is furthest; of equals the lowest id."""
    furthest = candidates.groupBy(cluster, candidate).agg(F.max(last_index).alias(last_index))
    best = F.min_by(F.struct(candidate, last_index), F.struct(-F.col(last_index), F.col(candidate)))
    return furthest.groupBy(cluster).agg(best.alias("b")).select(cluster, "b.*")


def propose(log: DataFrame, entries: DataFrame, term: int, order: list[str]) -> DataFrame:
    """entries with the log_index and term under which they are appended to the log, in the given order.

    Places come from the totals of ranges, so no single task sees all entries.
    """
    placed = maintenance.cut_by_size(entries, order, F.lit(1), 1, out="place")
    end = F.broadcast(log.agg(F.coalesce(F.max("log_index"), F.lit(-1)).alias("last")))  # one row
    return placed.crossJoin(end).withColumn("log_index", F.col("last") + F.col("place") + 1).withColumn("term", F.lit(term)).drop("place", "last")


def batches_to_peers(log: DataFrame, acks: DataFrame, batch: int = 64) -> DataFrame:
    """Per peer the entries past its match index, in batches of so many indexes; a peer that rejects one is asked again from
    its new match index."""
    peers = F.broadcast(acks.groupBy("peer_id").agg(F.max("match_index").alias("match_index")))  # a row a peer
    lacking = log.join(peers, F.col("log_index") > F.col("match_index"))
    return lacking.select("peer_id", "log_index", F.floor((F.col("log_index") - F.col("match_index") - 1) / batch).alias("batch"))


def vote_tally(votes: DataFrame, nodes: int) -> DataFrame:
    """Per term and candidate: distinct granters and whether they are a majority of all nodes."""
    n = F.countDistinct(F.when(F.col("granted"), F.col("voter")))
    return votes.groupBy("term", "candidate").agg(n.alias("n_votes"), (n > nodes // 2).alias("elected"))


def may_grant(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Vote rule: a candidate's (last_term, last_index) must not be behind this log's end."""
    end = log.agg(F.max(F.struct("term", "log_index")).alias("e"))
    ahead = (F.col("last_term") > F.coalesce("e.term", F.lit(0))) | ((F.col("last_term") == F.coalesce("e.term", F.lit(0))) & (F.col("last_index") >= F.coalesce("e.log_index", F.lit(0))))
    return requests.crossJoin(F.broadcast(end)).withColumn("log_ok", ahead).drop("e")


def first_divergence(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """first_conflict: least index at which both logs have entries of different terms (null: none)."""
    f = follower.select("log_index", F.col("term").alias("follower_term"))
    return leader.join(f, "log_index").where("term <> follower_term").agg(F.min("log_index").alias("first_conflict"))


def truncate_conflicts(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """The follower's entries before the first conflict."""
    cut = first_divergence(leader, follower)
    return follower.crossJoin(F.broadcast(cut)).where("first_conflict is null or log_index < first_conflict").drop("first_conflict")


def next_entries(log: DataFrame, next_index: int, batch: int = 64) -> DataFrame:
    """The slice sent to a peer: at most `batch` entries from next_index on."""
    return log.where(F.col("log_index").between(next_index, next_index + batch - 1)).orderBy("log_index")


def replica_lag(acks: DataFrame, head: int | None = None) -> DataFrame:
    """Per peer: match index and distance to the head (the greatest match when not given)."""
    peers = acks.groupBy("peer_id").agg(F.max("match_index").alias("match_index"))
    if head is not None:
        return peers.withColumn("lag", F.lit(head) - F.col("match_index"))
    return peers.crossJoin(F.broadcast(peers.agg(F.max("match_index").alias("head")))).select("peer_id", "match_index", (F.col("head") - F.col("match_index")).alias("lag"))


def lease_gaps(beats: DataFrame, node: str, ts: str, timeout_seconds: int, tie: str | None = None) -> DataFrame:
    """Each heartbeat with the seconds to the node's next one, whether the lease ran out between, and the session it belongs to."""
    order = [ts] + ([tie] if tie else [])
    w = Window.partitionBy(node).orderBy(*order)
    micros = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    starts = F.coalesce((micros > timeout_seconds * 1_000_000).cast("int"), F.lit(0))
    ahead = F.timestamp_diff("MICROSECOND", F.col(ts), F.lead(ts).over(w))
    out = beats.withColumn("__s", starts).withColumn("gap_micros", ahead).withColumn("expired", F.coalesce(ahead > timeout_seconds * 1_000_000, F.lit(False)))
    return out.withColumn("session", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__s")


def stale_nodes(beats: DataFrame, node: str, ts: str, now: Column | None, timeout_seconds: int) -> DataFrame:
    """Nodes silent for longer than the timeout; now is the latest heartbeat of all when not given."""
    last = beats.groupBy(node).agg(F.max(ts).alias("last_heartbeat"))
    if now is None:
        last = last.crossJoin(F.broadcast(last.agg(F.max("last_heartbeat").alias("now"))))  # one row
    silent = F.timestamp_diff("MICROSECOND", F.col("last_heartbeat"), F.col("now") if now is None else now)
    return last.where(silent > timeout_seconds * 1_000_000).select(node, "last_heartbeat")


def cluster_leader(beats: DataFrame, cluster: str, node: str, ts: str, leads: Column) -> DataFrame:
    """Per cluster: the node that led last (a later leader demotes the earlier one), nodes seen and last heartbeat."""
    return beats.groupBy(cluster).agg(
        F.max_by(F.when(leads, F.col(node)), F.when(leads, F.struct(ts, node))).alias("leader"),
        F.countDistinct(node).alias("n_nodes"),
        F.max(ts).alias("last_heartbeat"),
    )


def cluster_info(beats: DataFrame, cluster: str, node: str, address: str, ts: str, leads: Column) -> DataFrame:
    """A row a node: its cluster, the cluster's leader, and the node's latest address."""
    latest = beats.groupBy(cluster, node).agg(F.max_by(address, ts).alias("address"))
    return latest.join(cluster_leader(beats, cluster, node, ts, leads).select(cluster, "leader"), cluster).select(cluster, "leader", F.col(node).alias("peer"), "address")
