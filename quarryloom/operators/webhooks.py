"""Webhook deliveries: once each, routed, validated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(deliveries: DataFrame) -> DataFrame:
    return deliveries.dropDuplicates(["delivery_id"])


def route(deliveries: DataFrame, repos: DataFrame) -> DataFrame:
    """deliveries: delivery_id, event_type, github_repo_id, ref; repos: repo_id, github_repo_id, default_branch.

    Columns: delivery_id, outcome (ok, accepted, ignored), reason, repo_id.
    """
    r = repos.select("github_repo_id", F.col("repo_id").alias("known_repo"), "default_branch")
    push = F.col("event_type") == "push"
    reason = (
        F.when(~push & (F.col("event_type") != "ping"), "unsupported event")
        .when(push & ~F.coalesce("ref", F.lit("")).startswith("refs/heads/"), "not a branch")
        .when(push & F.col("known_repo").isNull(), "unknown repository")
        .when(push & (F.substring("ref", len("refs/heads/") + 1, 255) != F.col("default_branch")), "not the default branch")
    )
    return once(deliveries).join(r, "github_repo_id", "left").select(
        "delivery_id", F.when(reason.isNotNull(), "ignored").when(push, "accepted").otherwise("ok").alias("outcome"), reason.alias("reason"), F.when(reason.isNull() & push, F.col("known_repo")).alias("repo_id")
    )


def push_files(commits):
    """struct(added, modified, deleted) of an array of commits; a file may be in several."""
    of = lambda c: F.array_distinct(F.flatten(F.transform(commits, lambda x: F.coalesce(x[c], F.expr("cast(array() as array<string>)")))))
    return F.struct(of("added").alias("added"), of("modified").alias("modified"), of("removed").alias("deleted"))


def changed_entries(tree: DataFrame, diff: DataFrame) -> DataFrame:
    """Blobs of the tree that a push added or modified."""
    return tree.where("type = 'blob'").join(diff.where(F.col("kind").isin("added", "modified")).select("file_path").distinct(), "file_path", "left_semi")
