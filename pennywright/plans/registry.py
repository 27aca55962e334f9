"""Named queries: `run("card.categories", ledger)` -> DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame

_QUERIES: dict[str, Callable[..., DataFrame]] = {}


def named(name: str):
    """Register a function that returns a DataFrame under `name`."""
    def keep(fn):
        _QUERIES[name] = fn
        return fn
    return keep


def names() -> list[str]:
    load()
    return sorted(_QUERIES)


def run(name: str, *frames: DataFrame, **options) -> DataFrame:
    """Run a named query; an unknown name is a KeyError."""
    load()
    if name not in _QUERIES:
        raise KeyError(f"Unknown query: {name}")
    return _QUERIES[name](*frames, **options)


def load() -> None:
    """Import the modules that register queries."""
    from pennywright.plans import bank, card, live, portfolio, usage  # noqa: F401
