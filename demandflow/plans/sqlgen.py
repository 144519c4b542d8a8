"""Small helpers that write the DuckDB oracle SQL texts."""

from __future__ import annotations

from collections.abc import Sequence

# W-view measure columns used by profiling, outlier and clustering queries
W_MEASURES = ["demand", "temperature", "precipIntensity", "precipProbability",
              "cloudCover", "humidity", "windSpeed"]
# the reference's three clustering features, stood in by W columns
CLUSTER_FEATURES = ["temperature", "precipIntensity", "precipProbability"]

TS_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts_text(col: str) -> str:
    return TS_TEXT.format(col)


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def lit_list(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def describe_sql(src: str, cols: Sequence[str], keys: Sequence[str] = (), rnd: bool = True) -> str:
    """Oracle twin of ``profile.describe``."""
    k = "".join(f"{x}, " for x in keys)
    g = f"GROUP BY {', '.join(keys)}" if keys else ""
    parts = []
    for c in cols:
        stats = {
            "count": f"count({c})",
            "mean": f"avg({c})",
            "std": f"stddev_samp({c})",
            "min": f"min({c})::DOUBLE",
            "p25": f"quantile_cont({c}, 0.25)",
            "p50": f"quantile_cont({c}, 0.5)",
            "p75": f"quantile_cont({c}, 0.75)",
            "max": f"max({c})::DOUBLE",
        }
        sel = ", ".join((f"{r6(e)} AS {n}" if rnd and n != "count" else f"{e} AS {n}")
                        for n, e in stats.items())
        parts.append(f"SELECT {k}'{c}' AS \"column\", {sel} FROM {src} "
                     f"WHERE {c} IS NOT NULL {g}")
    return union_all(parts)
