"""Keyed lookups with fallbacks, and style text from a configuration table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Themes and their selector prefixes (fixed values).
THEMES = {"light": "", "dark": ".dark"}


def item_config(items: DataFrame, config: DataFrame) -> DataFrame:
    """``items`` (item_id, key, payload, inner) with the label of their configuration.

    The name looked up is payload[key], else inner[key], else the key; its entry in
    ``config`` (key, label) counts, else the key's own.
    """
    resolved = F.coalesce(F.try_element_at("payload", F.col("key")), F.try_element_at("inner", F.col("key")), F.col("key"))
    by_name = config.select(F.col("key").alias("name"), F.col("label").alias("by_name"))
    by_key = config.select(F.col("key").alias("own"), F.col("label").alias("by_key"))
    named = items.withColumn("resolved", resolved)
    joined = named.join(by_name, named.resolved == by_name.name, "left").join(by_key, named.key == by_key.own, "left")
    return joined.select("item_id", "resolved", F.when(F.col("name").isNotNull(), F.col("by_name")).otherwise(F.col("by_key")).alias("label"))


def theme_css(config: DataFrame, chart_id: str, themes: Mapping[str, str] = THEMES) -> DataFrame:
    """(theme, css) from ``config`` (ord, key, color, theme map): a block for each theme with a line for each
    entry that has a colour. Entries without colour and theme are left out; those that lack a
    colour in one theme leave an empty line there."""
    safe = chart_id.replace(":", "")
    entries = config.filter(F.col("theme").isNotNull() | (F.coalesce("color", F.lit("")) != ""))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("theme_name"), F.lit(p).alias("prefix")) for k, p in themes.items())))
    each = entries.select("ord", "key", "color", "theme", kinds.alias("t"))
    color = F.coalesce(F.nullif(F.try_element_at("theme", F.col("t.theme_name")), F.lit("")), F.nullif("color", F.lit("")))
    lines = each.select(F.col("t.theme_name").alias("theme"), F.col("t.prefix").alias("prefix"), F.struct("ord", F.concat(F.lit("  --color-"), "key", F.lit(": "), color, F.lit(";")).alias("line")).alias("entry"))
    grouped = lines.groupBy("theme", "prefix").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    body = F.array_join(F.transform("entries", lambda e: e["line"]), "\n", "")
    return grouped.select("theme", F.concat(F.lit("\n"), "prefix", F.lit(f" [data-chart={safe}] {{\n"), body, F.lit("\n}\n")).alias("css"))
