"""The list of checked queries: name -> (Spark function, SQL or None)."""

from checks.views import VIEWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, views: str) -> str:
    """Put the named views in front of `sql` as common table expressions."""
    if not views:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def check(name: str, sql: str = None, views: str = ""):
    """Register a function (spark, sf_dir) -> DataFrame with its comparison SQL."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn
    return keep


def add(name: str, fn, sql: str = None, views: str = "") -> None:
    check(name, sql, views)(fn)
