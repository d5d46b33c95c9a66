"""Name -> query and name -> check SQL."""

from wirelens.sources.views import with_views

QUERIES = {}
ORACLES = {}


def query(name: str):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        return fn
    return register


def oracle(name: str, views: list[str], body: str, ctes: dict[str, str] | None = None, recursive=False):
    ORACLES[name] = with_views(views, ctes or {}, body, recursive)
