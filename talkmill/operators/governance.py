"""Leak scans, coverage reports and publication checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leak_scan(df: DataFrame, columns: list[str], pattern: str, longer_than: int = 60) -> DataFrame:
    """(column_name, n_suspect, longest): free text that looks like raw transcript; one pass for all columns."""
    each = F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column_name", "cell")
    bad = (F.length("cell") > longer_than) & F.col("cell").rlike(pattern)
    return df.select(each).groupBy("column_name").agg(F.count_if(bad).alias("n_suspect"), F.coalesce(F.max(F.length("cell")), F.lit(0)).alias("longest"))


def pattern_scan(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, pattern) of every pattern found in a text."""
    names = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return df.select(key, F.explode(names).alias("pattern"))


def prompt_leak(prompt: Column, marker: str, names: list[str]) -> tuple[Column, Column]:
    """Class names before the marker (forbidden), and in the transcript after it (only counted)."""
    head = F.substring_index(prompt, marker, 1)
    tail = F.when(F.contains(prompt, F.lit(marker)), F.substring(prompt, F.length(head) + F.lit(len(marker) + 1), F.length(prompt))).otherwise("")
    found = lambda text: F.size(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n)))
    return found(head), found(tail)


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_missing, share_missing) of each column."""
    each = F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).isNull())])).alias("column_name", "missing")
    return df.select(each).groupBy("column_name").agg(F.count_if("missing").alias("n_missing"), F.avg(F.col("missing").cast("int")).alias("share_missing"))


def coverage(ids: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(table_name, n_ids, n_covered): how many ids each table has."""
    out = None
    for name, table in tables.items():
        row = ids.select(key).join(table.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_ids"), F.count("_in").alias("n_covered"))
        out = row if out is None else out.unionByName(row)
    return out


def classify_by_prefix(name: Column, rules: dict[str, str], other: str = "other") -> Column:
    """The class of the longest prefix that fits."""
    out = F.lit(other)
    for prefix in sorted(rules, key=len):
        out = F.when(name.startswith(prefix), rules[prefix]).otherwise(out)
    return out


def strip_columns(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """The table without columns that must not be published; those it doesn't have are no error."""
    return df.drop(*[c for c in forbidden if c in df.columns])


def publish(tables: dict[str, DataFrame], allowed: dict[str, list[str]], folder: str) -> list[dict]:
    """Write the tables on a whitelist (name -> columns to strip) as Parquet below ``folder``.

    Returns the inventory of all tables: state 'published' or 'held back', and the reason.
    """
    out = []
    for line in inventory(tables):
        name = line["table"]
        if name not in allowed:
            out.append({**line, "state": "held back", "reason": "not on the whitelist"})
            continue
        strip_columns(tables[name], allowed[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        gone = [c for c in allowed[name] if c in tables[name].columns]
        out.append({**line, "state": "published", "reason": f"without {', '.join(gone)}" if gone else ""})
    return out


def inventory(tables: dict[str, DataFrame]) -> list[dict]:
    """Name, rows, columns and first eight column names of tables to publish."""
    return [{"table": n, "rows": df.count(), "columns": len(df.columns), "first_columns": df.columns[:8]} for n, df in tables.items()]


def exclusion_log(df: DataFrame, ok: Column, reason: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rejected keys with the reason); null passes nothing."""
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok).select(*keys, F.lit(reason).alias("exclusion_reason"))
