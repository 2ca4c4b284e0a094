"""Version-history indicators from per-file line changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.bands import THRESHOLDS, band_of, band_of_sql, guarded

CODES = ("L1.1", "L1.2", "L1.3", "L1.4", "L1.5", "L1.6", "L1.7")


def history_panel(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by…, code, value, band) of L1.1 to L1.7 from (sha, kind, added, deleted); binary files have NULL lines.

    One shuffle by commit with partial aggregation, then one of a few sums.  Commits without files don't exist here."""
    by = by or []
    a, d = F.coalesce("added", F.lit(0)), F.coalesce("deleted", F.lit(0))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    commit = changes.groupBy(*by, "sha").agg(
        F.bool_or(F.col("kind") == "doc").alias("doc"), F.bool_or(F.col("kind") == "code").alias("code"),
        F.sum(a).alias("a"), F.sum(d).alias("d"), of("doc", a).alias("da"), of("code", a).alias("ca"), of("code", d).alias("cd"),
    )
    n = F.count("*")
    values = {
        "L1.1": guarded(F.count_if(F.col("doc") & ~F.col("code")), n), "L1.2": guarded(F.count_if(~F.col("doc") & F.col("code")), n),
        "L1.3": guarded(F.count_if(F.col("doc") & F.col("code")), n), "L1.4": guarded(F.sum("da"), F.sum("a")), "L1.5": guarded(F.sum("cd"), F.sum("ca")),
        "L1.6": guarded(F.count_if(F.col("d") > F.col("a")), n), "L1.7": guarded(F.count_if((F.col("a") > 0) & (F.try_divide(F.col("d"), F.col("a")) > 0.4)), n),
    }
    wide = commit.groupBy(*by).agg(*(v.alias(c.replace(".", "_")) for c, v in values.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("code"), F.round(F.col(c.replace(".", "_")), 6).alias("value"), band_of(c, F.col(c.replace(".", "_"))).alias("band")) for c in values))
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def history_sql(changes: str, by: str = "") -> str:
    """The same in SQL over a relation of (by, sha, kind, added, deleted)."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    rows = " UNION ALL ".join(f"SELECT {keys}'{c}' AS code, round({c.replace('.', '_')}, 6) AS value, {band_of_sql(c, c.replace('.', '_'))} AS band FROM wide" for c in CODES)
    return f"""
WITH changes AS ({changes}),
c AS (SELECT {keys}sha, bool_or(kind = 'doc') AS doc, bool_or(kind = 'code') AS code, sum(coalesce(added, 0)) AS a, sum(coalesce(deleted, 0)) AS d,
  sum(CASE WHEN kind = 'doc' THEN coalesce(added, 0) ELSE 0 END) AS da, sum(CASE WHEN kind = 'code' THEN coalesce(added, 0) ELSE 0 END) AS ca,
  sum(CASE WHEN kind = 'code' THEN coalesce(deleted, 0) ELSE 0 END) AS cd FROM changes GROUP BY {keys}sha),
wide AS (SELECT {keys}count(*) FILTER (doc AND NOT code) * 100.0::DOUBLE / count(*) AS L1_1, count(*) FILTER (code AND NOT doc) * 100.0::DOUBLE / count(*) AS L1_2,
  count(*) FILTER (doc AND code) * 100.0::DOUBLE / count(*) AS L1_3, sum(da) / nullif(sum(a), 0) * 100 AS L1_4, sum(cd) / nullif(sum(ca), 0) * 100 AS L1_5,
  count(*) FILTER (d > a) * 100.0::DOUBLE / count(*) AS L1_6, count(*) FILTER (a > 0 AND d / nullif(a, 0) > 0.4) * 100.0::DOUBLE / count(*) AS L1_7 FROM c {group})
{rows}"""


assert set(CODES) <= set(THRESHOLDS)
