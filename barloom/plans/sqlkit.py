"""Small builders for the DuckDB twins."""

P = "PARTITION BY symbol ORDER BY bar_date"


def last_n(n: int) -> str:
    return f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior_n(n: int) -> str:
    return f"({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def full(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {last_n(n)} = {n} THEN {agg}({x}) OVER {last_n(n)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) OVER ({P}))"


def z(x: str, n: int) -> str:
    return f"(({x} - {full('avg', x, n)}) / nullif({full('stddev_samp', x, n)}, 0))"


def corr(x: str, y: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {last_n(n)} = {n} THEN covar_samp({x}, {y}) OVER {last_n(n)} / nullif(stddev_samp({x}) OVER {last_n(n)} * stddev_samp({y}) OVER {last_n(n)}, 0) END)"


def flag(c: str) -> str:
    return f"CAST(coalesce({c}, false) AS DOUBLE)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def rs(names: list[str], digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def pct_rank(x: str, by: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END)"
