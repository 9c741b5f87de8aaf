"""Rendering and bookkeeping of managed resources: entries, descriptions, check roll-ups, sets of enabled tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def described(rows: DataFrame, limit: int = 80) -> DataFrame:
    """name, description: the front matter's, else the first heading or line of more than ten characters, cut at ``limit``."""
    given = F.regexp_extract("content", r"(?s)^\s*---\n.*?(?:^|\n)description:[ \t]*([^\n]+)\n.*?---", 1)
    body = F.regexp_replace("content", r"(?s)^\s*---\n.*?\n---\n?", "")
    lines = F.filter(F.transform(F.split(body, "\n", -1), lambda x: tx.trimmed(F.regexp_replace(x, r"^#+\s*", ""))), lambda x: F.length(x) > 10)
    text = F.coalesce(F.when(given != "", tx.trimmed(given)), F.get(lines, F.lit(0)), F.lit(""))
    return rows.select("name", F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text).alias("description"))


def rendered_json(name: Column, command: Column, args: Column, env: Column) -> Column:
    """A server entry as JSON; absent fields are left out."""
    return F.to_json(F.struct(name.alias("name"), command.alias("command"), F.when(F.size(args) > 0, args).alias("args"), F.when(F.size(env) > 0, env).alias("env")))


def rendered_toml(name: Column, command: Column, args: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    listed = F.concat(F.lit("["), F.array_join(F.transform(args, quoted), ", "), F.lit("]"))
    return F.concat(F.lit("[servers."), name, F.lit("]\ncommand = "), quoted(command), F.when(F.size(args) > 0, F.concat(F.lit("\nargs = "), listed)).otherwise(F.lit("")), F.lit("\n"))


def rolled_up(checks: DataFrame) -> DataFrame:
    """ok, warn, error counts and the worst level of checks. checks: level."""
    counts = checks.agg(*[F.count_if(F.col("level") == k).alias(k) for k in ("ok", "warn", "error")])
    return counts.withColumn("worst", F.when(F.col("error") > 0, "error").when(F.col("warn") > 0, "warn").otherwise("ok"))


def counted_by_type(resources: DataFrame, types: DataFrame) -> DataFrame:
    """type, n: types without resources stay, with 0."""
    return types.select("type").join(resources.groupBy("type").agg(F.count("*").alias("n")), "type", "left").fillna(0, ["n"])


def hooks_present(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """tool, complete: whether every desired hook stands there. Both: tool, command."""
    missing = desired.join(existing.select("tool", "command").distinct(), ["tool", "command"], "left_anti").select("tool", F.lit(True).alias("lacks")).distinct()
    return desired.select("tool").distinct().join(missing, "tool", "left").select("tool", F.col("lacks").isNull().alias("complete"))


def after_uninstall(enabled: Column, disabled: Column, tool: Column) -> Column:
    """The tool joins the disabled ones and leaves the enabled ones; an absent list of enabled ones stays absent."""
    return F.struct(F.array_sort(F.array_except(enabled, F.array(tool))).alias("enabled"), F.array_sort(F.array_union(F.coalesce(disabled, F.expr("cast(array() as array<string>)")), F.array(tool))).alias("disabled"))


def collected(store: DataFrame, items: DataFrame) -> DataFrame:
    """The store with items of the same name replaced, and contributors joined without repeats. Both: name, content, by (array)."""
    old = store.select("name", F.col("content").alias("old"), F.col("by").alias("old_by"))
    new = items.select("name", F.col("content").alias("new"), F.col("by").alias("new_by"))
    none = F.expr("cast(array() as array<string>)")
    return old.join(new, "name", "full_outer").select("name", F.coalesce("new", "old").alias("content"), F.array_union(F.coalesce("old_by", none), F.coalesce("new_by", none)).alias("by"))


def removed(store: DataFrame, names: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store without the names, tombstones with them)."""
    return store.join(names, "name", "left_anti"), tombstones.select("name").union(names.select("name")).distinct()
