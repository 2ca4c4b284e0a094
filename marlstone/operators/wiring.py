"""Controls that a page emits against the options that a library reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def option_of(attribute: Column) -> Column:
    """`data-hover-bg` as `hoverBg`."""
    words = F.split(F.regexp_replace(attribute, "^data-", ""), "-")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), "")


def wiring(controls: DataFrame, library: DataFrame, internal: list[str] | None = None) -> DataFrame:
    """(component, found, matched, dead, hidden): emitted and read, emitted only, read only.

    Without a library entry everything emitted is dead and nothing hidden."""
    read = library.select(F.col("name").alias("enhance_name"), F.col("opts_read").alias("_read"))
    joined = controls.join(read, "enhance_name", "left").withColumn("_options", F.transform("render_attrs", option_of))
    there = F.col("_read").isNotNull()
    none = F.array().cast("array<string>")
    keep = F.array(*map(F.lit, internal or [])).cast("array<string>")
    result = joined.select("component", there.alias("found"), F.when(there, F.array_sort(F.array_intersect("_options", "_read"))).otherwise(none).alias("matched"), F.array_sort(F.when(there, F.array_except("_options", "_read")).otherwise(F.col("_options"))).alias("dead"), F.when(there, F.array_sort(F.array_except(F.array_except("_read", "_options"), keep))).otherwise(none).alias("hidden"))
    return result.orderBy(F.size("dead").desc(), F.size("hidden").desc(), "component")
