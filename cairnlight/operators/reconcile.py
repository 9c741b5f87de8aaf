"""Declarative reconciliation of managed resources: plans of what to add, update, remove or skip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def store_diff(local: DataFrame, store: DataFrame) -> DataFrame:
    """type, name, change of resources that stand on one side only."""
    keys = ["type", "name"]
    added = local.select(*keys).distinct().join(store, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(store.select(*keys).distinct().join(local, keys, "left_anti").withColumn("change", F.lit("removed")))


def tag_included(items: DataFrame, tags: DataFrame, subscribed: list[str]) -> DataFrame:
    """name, included: no subscription or no tags includes; else the two must meet. tags: name, tags (array)."""
    mine = F.array(*map(F.lit, subscribed)) if subscribed else F.expr("cast(array() as array<string>)")
    rows = items.join(tags, "name", "left")
    return rows.select("name", (F.lit(not subscribed) | F.col("tags").isNull() | (F.size("tags") == 0) | F.arrays_overlap("tags", mine)).alias("included"))


def tag_stats(tags: DataFrame) -> DataFrame:
    """tag, skills, rules. tags: type, name, tags."""
    return tags.select("type", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count_if(F.col("type") == "skill").alias("skills"), F.count_if(F.col("type") == "rule").alias("rules"))


def host_of(url: Column) -> Column:
    return F.lower(F.expr("try_parse_url(url, 'HOST')")) if url is None else F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def host_allowed(url: Column, allowed: list[str]) -> Column:
    """An allow-list of hosts; ``*.`` stands for any subdomain. An empty list allows all."""
    host = host_of(url)
    tests = [host.endswith(a[1:]) if a.startswith("*.") else host == a for a in allowed]
    return reduce(lambda a, b: a | b, tests, F.lit(not allowed))


def safe_name(name: Column) -> Column:
    """A resource name that can't leave its folder."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.contains("..")


def safe_command(command: Column, allowed: list[str]) -> Column:
    return command.rlike(r"^[A-Za-z0-9._/+-]+$") & (F.lit(not allowed) | tx.basename(command).isin(*allowed))


def fan_out(items: DataFrame, tools: DataFrame, disabled: list[str]) -> DataFrame:
    """A row for each item and tool that is configured, installed and not disabled. Tools are a list of a few, checked."""
    usable = tools.where(F.col("configured") & F.col("installed") & ~F.col("tool").isin(*disabled)).select("tool")
    names = [r["tool"] for r in usable.limit(257).collect()]
    if len(names) > 256:
        return items.join(usable)
    return items.select("*", F.explode(F.array(*map(F.lit, sorted(names))) if names else F.expr("cast(array() as array<string>)")).alias("tool"))


def three_way(desired: DataFrame, existing: DataFrame, owned: DataFrame, force: bool = False) -> DataFrame:
    """name, action, reason. desired: name, hash, reason (of skipping, or null); existing: name, hash; owned: name, hash.

    The first reason that a desired entry is skipped for counts. An entry that stands but isn't owned is the user's.
    """
    d = desired.select("name", F.col("hash").alias("want"), F.col("reason").alias("skip"), F.lit(True).alias("in_desired"))
    e = existing.select("name", F.col("hash").alias("there"))
    o = owned.select("name", F.col("hash").alias("mine"))
    rows = d.join(e, "name", "full_outer").join(o, "name", "full_outer")
    wanted = F.col("in_desired") & F.col("skip").isNull()
    foreign = F.col("there").isNotNull() & F.col("mine").isNull() & F.lit(not force)
    action = (
        F.when(F.col("in_desired") & F.col("skip").isNotNull(), "skipped")
        .when(wanted & foreign, "skipped")
        .when(wanted & F.col("there").isNull(), "added")
        .when(wanted & (F.coalesce("mine", F.lit("")) != F.col("want")), "updated")
        .when(wanted, "unchanged")
        .when(F.col("mine").isNotNull(), "removed")
    )
    reason = F.when(F.col("in_desired") & F.col("skip").isNotNull(), F.col("skip")).when(wanted & foreign, "user-owned")
    return rows.select("name", action.alias("action"), reason.alias("reason")).where("action is not null")


def skip_reason(tests: dict[str, Column]) -> Column:
    """The first reason that holds, in the order given."""
    return F.coalesce(*[F.when(t, r) for r, t in tests.items()])


def hooks_after(existing: DataFrame, managed: DataFrame, desired: DataFrame) -> DataFrame:
    """event, hooks, write: untouched entries, then the desired ones; ``write`` where that differs from what stands.

    existing, desired: event, pos, command; managed: event, command.
    """
    untouched = existing.join(managed.select("event", "command").distinct(), ["event", "command"], "left_anti").select("event", F.lit(0).alias("part"), "pos", "command")
    after = untouched.unionByName(desired.select("event", F.lit(1).alias("part"), "pos", "command"))
    listed = lambda df, cols: df.groupBy("event").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*cols, "command"))), lambda x: x["command"]), "|").alias("hooks"))
    new = listed(after, ["part", "pos"])
    old = listed(existing, ["pos"]).withColumnRenamed("hooks", "before")
    return new.join(old, "event", "full_outer").select("event", F.coalesce("hooks", F.lit("")).alias("hooks"), (F.coalesce("hooks", F.lit("")) != F.coalesce("before", F.lit(""))).alias("write"))


def hook_overrides(builtin: DataFrame, disabled: list[str], timeouts: DataFrame) -> DataFrame:
    """Built-in hooks that aren't disabled, with their own or the given timeout. builtin: key, timeout."""
    kept = builtin.where(~F.col("key").isin(*disabled)) if disabled else builtin
    return kept.join(timeouts.select("key", F.col("timeout").alias("given")), "key", "left").select("key", F.coalesce("given", "timeout").alias("timeout"))


def latest_candidates(rows: DataFrame) -> DataFrame:
    """name, path, mtime of the newest copy of each name; the smaller path of equals. rows: name, path, mtime."""
    return rows.groupBy("name").agg(F.max("mtime").alias("mtime"), F.min_by("path", F.struct(-F.col("mtime"), F.col("path"))).alias("path"))


def folder_relation(left: DataFrame, right: DataFrame) -> DataFrame:
    """root, subset, equal of folders that share a root name. left, right: root, rel, hash."""
    both = left.select("root", "rel", F.col("hash").alias("l")).join(right.select("root", "rel", F.col("hash").alias("r")), ["root", "rel"], "full_outer")
    return both.groupBy("root").agg((F.count_if(F.col("l").isNotNull() & (F.col("r").isNull() | (F.col("l") != F.col("r")))) == 0).alias("subset"), (F.count_if(~F.col("l").eqNullSafe(F.col("r"))) == 0).alias("equal"))


def provenance(items: DataFrame, builtin: DataFrame, team: DataFrame, source: DataFrame) -> DataFrame:
    """name, origin: the first of built-in, team and source that has the name, else local-only."""
    rows = items
    for label, table in (("builtin", builtin), ("team", team), ("source", source)):
        rows = rows.join(table.select("name", F.lit(label).alias(label)).distinct(), "name", "left")
    return rows.select("name", F.coalesce("builtin", "team", "source", F.lit("local-only")).alias("origin"))


def merge_conflicts(fields: DataFrame) -> DataFrame:
    """agent, field, n_values of fields with more than one value across tools. fields: agent, field, value."""
    return fields.where("value is not null").groupBy("agent", "field").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def substituted(entries: DataFrame, variables: DataFrame) -> DataFrame:
    """id, text, missing: ``${NAME}`` replaced by its value; names without one are listed. Variables: name, value."""
    used = entries.select("id", F.explode(tx.placeholders(F.col("text"))).alias("name"))
    found = used.join(variables, "name", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("vars"))
    rows = entries.join(found, "id", "left")
    known = F.filter(F.coalesce("vars", F.expr("cast(array() as array<struct<name:string,value:string>>)")), lambda v: v["value"].isNotNull())
    text = F.aggregate(known, F.col("text"), lambda t, v: F.replace(t, F.concat(F.lit("${"), v["name"], F.lit("}")), v["value"]))
    missing = F.array_join(F.transform(F.filter("vars", lambda v: v["value"].isNull()), lambda v: v["name"]), ",")
    return rows.select("id", text.alias("text"), F.coalesce(missing, F.lit("")).alias("missing"))


def uninstall_plan(resources: DataFrame, target: str) -> DataFrame:
    """What goes with a tool: its own resources, and shared ones that no other tool has. resources: tool, name, shared."""
    per = resources.groupBy("name", "shared").agg(F.bool_or(F.col("tool") == target).alias("mine"), F.bool_or(F.col("tool") != target).alias("others"))
    return per.where("mine").select("name", F.when(F.col("shared") & F.col("others"), "kept-shared").otherwise("removed").alias("action"))


def dispatched(events: DataFrame, handlers: DataFrame) -> DataFrame:
    """event_id, output: handlers of equal event and matcher run in order, the first output counts.

    events: event_id, event, matcher; handlers: event, matcher, ordinal, output.
    """
    hit = events.join(handlers, ["event", "matcher"]).where("output is not null")
    return hit.groupBy("event_id").agg(F.min_by("output", "ordinal").alias("output"))


def marked_section_removed(text: Column, start: str, end: str) -> Column:
    """The text without its marked section; null where nothing is left."""
    import re

    out = tx.trimmed(F.regexp_replace(text, rf"(?s)\n*{re.escape(start)}.*?{re.escape(end)}\n*", "\n"))
    return F.when(out != "", out)


def rendered_hash(entry: Column) -> Column:
    """The first 16 hex digits of an entry's SHA-1."""
    return F.substring(F.sha1(entry), 1, 16)
