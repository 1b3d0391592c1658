"""Commit store: first-write-wins saves, owner filters, write policies,
constraints and the audit-log queries.

Scale notes
* keep-first and top-k per group are ``row_number() <= k`` windows; Spark
  plans a partial ``WindowGroupLimit`` before the shuffle, so a hot hash or
  a hot user ships at most k rows per map task.
* joins carry no broadcast hints: Spark/AQE broadcast a side only after
  checking its (runtime) size and fall back to a shuffle join otherwise;
  AQE's skew-join splits a hot key on the big side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import LOG_PAGE, STATUS_ACCEPTED, STATUS_ROLLBACK
from ..functions.scalars import is_blank, profile_username
from ..session import path_exists
from .keyed_store import KeyedTable, delete_where, insert_new, update_where, winners


def first_write_order() -> list[Column]:
    """Arrival order of writes: time, unknown times last, then id."""
    return [F.col("created_at").asc_nulls_last(), F.col("commit_id").asc()]


def log_order() -> list[Column]:
    """Audit log order: newest first, null times first, id tie-break."""
    return [F.col("created_at").desc_nulls_first(), F.col("commit_id").asc()]


def drop_blank_code(df: DataFrame, code_col: str = "code_content") -> DataFrame:
    return df.where(~is_blank(F.col(code_col)))


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str | None = None) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col).withColumn(rank_col, F.col(rank_col).cast("long"))
    return out.drop("_rn")


def ordinal_index(df: DataFrame, order_col: str, out_col: str = "ordinal", block_rows: int = 1 << 20) -> DataFrame:
    """Zero-based position of each row in ``order_col`` order (an integral,
    unique column), without a single-partition window.

    Dense keys are grouped in blocks of ``block_rows`` consecutive key values;
    where keys are sparse the block widens with the key range, so that there
    are never more than about 65,536 blocks.  The block counts (one row per
    block) give offsets by a small running sum, and a row's position is its
    block offset plus its rank inside the block."""
    width = df.select(F.greatest(F.lit(block_rows).cast("double"),
                                 (F.max(order_col) - F.min(order_col)) / F.lit(65536.0))).scalar()
    b = df.withColumn("_blk", F.floor(F.col(order_col) / width))
    counts = b.groupBy("_blk").agg(F.count("*").alias("_n"))
    offsets = counts.select("_blk", (F.sum("_n").over(
        Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    w = Window.partitionBy("_blk").orderBy(order_col)
    return (b.join(offsets, "_blk")
            .withColumn(out_col, (F.coalesce(F.col("_off"), F.lit(0))
                                  + F.row_number().over(w) - 1).cast("long"))
            .drop("_blk", "_off"))


def first_commit_per_hash(df: DataFrame) -> DataFrame:
    """The stored row per global commit_hash (first write wins)."""
    return top_k_per_group(df, ["commit_hash"], first_write_order(), 1)


def new_rows(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of a batch that a save would insert: first per hash within the
    batch, minus hashes already stored (idempotent: replaying a saved batch
    inserts nothing)."""
    return first_commit_per_hash(incoming).join(store.select("commit_hash"), "commit_hash", "left_anti")


def save_commits_to(spark, path: str, incoming: DataFrame) -> None:
    """Append the new rows of a batch to a parquet store at ``path`` (any
    Hadoop file system).  Single writer per path; replaying a batch appends
    nothing; a batch without one of the store's columns is an error."""
    if path_exists(spark, path):
        stored = spark.read.parquet(path)
        new = new_rows(stored, incoming).select(*stored.columns)
    else:
        new = first_commit_per_hash(incoming)
    new.write.mode("append").parquet(path)


def resolve_conflicts(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each incoming row with the row that holds its hash after sequential
    inserts (stored rows precede the batch): ``stored_commit_id``,
    ``stored_created_at`` and a correct ``is_duplicate``."""
    keys = ["commit_hash", "commit_id", "created_at"]
    both = (store.select(*keys, F.lit(0).alias("_src"))
            .unionByName(incoming.select(*keys, F.lit(1).alias("_src"))))
    winners = top_k_per_group(both, ["commit_hash"], [F.col("_src").asc()] + first_write_order(), 1)
    winners = winners.select("commit_hash", F.col("commit_id").alias("stored_commit_id"),
                             F.col("created_at").alias("stored_created_at"))
    return (incoming.join(winners, "commit_hash", "left")
            .withColumn("is_duplicate", F.col("stored_commit_id") != F.col("commit_id")))


def resolve_against(table: KeyedTable, incoming: DataFrame) -> DataFrame:
    """``resolve_conflicts`` against a keyed commit table: the stored rows of the
    batch's hashes are looked up in their buckets, and the batch alone moves."""
    held = winners(table, incoming, first_write_order())
    held = held.select(table.key, F.col("commit_id").alias("stored_commit_id"), F.col("created_at").alias("stored_created_at"))
    return incoming.join(held, table.key, "left").withColumn("is_duplicate", F.col("stored_commit_id") != F.col("commit_id"))


def apply_writes(table: KeyedTable, changes: DataFrame, offered: DataFrame, values: list[str], batch_id: int) -> DataFrame:
    """Judge the requests of a batch against the stored rows, then carry out the
    accepted ones: deletes, updates (which set ``values``), and inserts of
    ``offered`` rows whose hash is free by then.  Returns the judgements.

    A request names its row by ``commit_id``; all are judged on the state before
    the batch, and of several updates of a row the one with the greatest values
    stands.  Every step is a published version under the batch's number, so a
    replay after a failure goes on behind the last step that was done; the
    judgements are written first and the replay keeps to them."""
    judged = materialize_once(table, "judged", batch_id, lambda: authorized_writes(changes, table.read(), *values))
    accepted = judged.where("accepted")
    delete_where(table, accepted.where("op = 'delete'").select("commit_id"), "commit_id", "deletes", batch_id)
    updates = accepted.where("op = 'update'").groupBy("commit_id").agg(F.max(F.struct(*values)).alias("v")).select("commit_id", "v.*")
    update_where(table, updates, "commit_id", "updates", batch_id)
    new = offered.join(accepted.where("op = 'insert'").select("commit_id"), "commit_id", "left_semi")
    insert_new(table, new, first_write_order(), "inserts", batch_id)
    return judged.drop(*values)


def materialize_once(table: KeyedTable, name: str, batch_id: int, make) -> DataFrame:
    """``make()`` as written beside the table by the first attempt at a batch."""
    path = f"{table.root}/{name}/batch={batch_id}"
    if not path_exists(table.spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return table.spark.read.parquet(path)


def owner_rows(commits: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """Rows each actor may read: own rows (``actors`` holds ``user_id``);
    ``None`` is the service role, which reads everything."""
    if actors is None:
        return commits
    return commits.join(actors.select("user_id").distinct(), "user_id", "left_semi")


def authorized_writes(changes: DataFrame, current: DataFrame, *carried: str) -> DataFrame:
    """Row-policy check for insert/update/delete requests.  USING needs the
    actor to own the old row, WITH CHECK to own the new one.  ``carried``
    columns of the requests come along."""
    cur = current.select("commit_id", F.col("user_id").alias("old_user_id"))
    j = changes.join(cur, "commit_id", "left")
    actor, old, new, op = F.col("actor_id"), F.col("old_user_id"), F.col("new_user_id"), F.col("op")
    using_ok = actor == old
    check_ok = actor == new
    reason = (F.when(op == "insert", F.when(check_ok, F.lit("ok")).otherwise(F.lit("with_check_failed")))
              .when(old.isNull(), F.lit("row_not_found"))
              .when(~using_ok, F.lit("using_failed"))
              .when((op == "update") & ~check_ok, F.lit("with_check_failed"))
              .otherwise(F.lit("ok")))
    return j.select("commit_id", "op", "actor_id", "old_user_id", "new_user_id",
                    (reason == "ok").alias("accepted"), reason.alias("reason"), *carried)


def orphan_commits(commits: DataFrame, users: DataFrame) -> DataFrame:
    return commits.join(users.select("user_id"), "user_id", "left_anti")


def cascade_delete(commits: DataFrame, deleted_users: DataFrame) -> DataFrame:
    """Commits left after deleting users (their commits go with them)."""
    return commits.join(deleted_users.select("user_id"), "user_id", "left_anti")


def constraint_reasons(df: DataFrame) -> Column:
    """Array of violated column constraints of the commit table."""
    checks = [
        (F.col("user_id").isNull(), "user_id is null"),
        (F.col("commit_hash").isNull(), "commit_hash is null"),
        (F.col("code_content").isNull(), "code_content is null"),
        (F.col("risk_score").isNull(), "risk_score is null"),
        ((F.col("risk_score") < 0) | (F.col("risk_score") > 100), "risk_score out of range"),
        (F.col("status").isNull() | ~F.col("status").isin(STATUS_ACCEPTED, STATUS_ROLLBACK),
         "status not allowed"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected-with-reasons) from one pass of reasons."""
    tagged = df.withColumn("violations", constraint_reasons(df))
    valid = tagged.where(F.size("violations") == 0).drop("violations")
    rejected = tagged.where(F.size("violations") > 0)
    return valid, rejected


def unique_violations(users: DataFrame, commits: DataFrame) -> DataFrame:
    """Keys that break a UNIQUE constraint: (key_name, key_value, n)."""
    def dup(df: DataFrame, col: str) -> DataFrame:
        return (df.groupBy(F.col(col).alias("key_value")).agg(F.count("*").alias("n"))
                .where(F.col("n") > 1).select(F.lit(col).alias("key_name"), "key_value", "n"))

    return dup(users, "username").unionByName(dup(users, "email")).unionByName(dup(commits, "commit_hash"))


def latest_per_user(commits: DataFrame, k: int = LOG_PAGE) -> DataFrame:
    """The audit-log page of every user at once (rank 1 = newest)."""
    return top_k_per_group(commits, ["user_id"], log_order(), k, rank_col="log_rank")


def recent_logs(commits: DataFrame, user_id, k: int = LOG_PAGE) -> DataFrame:
    """One user's audit log page.  On a stored table the owner filter reaches
    the scan; on commits that are still to be deduplicated it stays above the
    first-write window, which must see every owner's rows."""
    return commits.where(F.col("user_id") == F.lit(user_id)).orderBy(*log_order()).limit(k)


def commits_per_user(commits: DataFrame, k: int = LOG_PAGE) -> DataFrame:
    return (commits.groupBy("user_id").agg(F.count("*").alias("n_commits"))
            .withColumn("n_shown", F.least(F.col("n_commits"), F.lit(k).cast("long"))))


def log_with_user(commits: DataFrame, users: DataFrame) -> DataFrame:
    """Commit rows with the owner's profile (many-to-one, missing -> null)."""
    return commits.join(users.select("user_id", "username", "email"), "user_id", "left")


def log_projection(df: DataFrame) -> DataFrame:
    return df.select(
        "commit_id", "commit_hash", "risk_score",
        F.coalesce(F.col("username"), F.lit("unknown")).alias("user"),
        F.col("created_at").alias("timestamp"), "status", "dlt_tx_hash")


def commit_lookup(store: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch detail lookup by (id, owner): a request sees a row only if it
    owns it; otherwise ``found`` is false and the fields are null."""
    s = store.select("commit_id", F.col("user_id").alias("_owner"), "commit_hash",
                     "risk_score", "status", "dlt_tx_hash", "created_at")
    j = requests.join(s, (requests["commit_id"] == s["commit_id"]) &
                      (requests["requester_id"] == s["_owner"]), "left")
    found = s["_owner"].isNotNull()
    return j.select(requests["commit_id"], "requester_id", found.alias("found"),
                    "commit_hash", "risk_score", "status", "dlt_tx_hash",
                    F.col("created_at").alias("timestamp"))


def code_with_fallback(details: DataFrame, objects: DataFrame) -> DataFrame:
    """Table code, else the object-store copy, else ''."""
    o = objects.select("user_id", "commit_hash", F.col("code_content").alias("_obj_code"))
    j = details.join(o, ["user_id", "commit_hash"], "left")
    return j.withColumn("code_content", F.coalesce(F.nullif(F.col("code_content"), F.lit("")),
                                                   F.col("_obj_code"), F.lit(""))).drop("_obj_code")


def profile_defaults(auth_users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles to create for identities without one."""
    missing = auth_users.join(profiles.select("user_id"), "user_id", "left_anti")
    return missing.select("user_id", "email",
                          profile_username(F.col("meta_username"), F.col("email")).alias("username"))
