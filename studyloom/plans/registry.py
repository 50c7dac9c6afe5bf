"""Name -> (plan over the views, SQL oracle or None)."""
import re
from dataclasses import dataclass
from typing import Callable, Optional

from studyloom.sources.views import VIEW_SQL, Views


@dataclass
class Query:
    plan: Callable
    oracle: Optional[str]


REGISTRY: dict[str, Query] = {}


def query(name, oracle=None):
    """Register ``plan(views)`` under ``name``; ``oracle`` is DuckDB SQL over the tables and the v_* views."""
    def add(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(fn, oracle)
        return fn
    return add


def _views_in(sql):
    return [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]


def with_views(sql):
    """Put the definitions of the v_* views that ``sql`` uses in front of it as common table expressions."""
    need, todo = set(), _views_in(sql)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += _views_in(VIEW_SQL[v])
    ctes = [f"{v} AS ({VIEW_SQL[v]})" for v in VIEW_SQL if v in need]
    if not ctes:
        return sql.strip()
    body = sql.strip()
    if re.match(r"(?is)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + re.sub(r"(?is)^with\s+recursive\s+", "", body)
    if re.match(r"(?is)with\b", body):
        return "WITH " + ", ".join(ctes) + ", " + re.sub(r"(?is)^with\s+", "", body)
    return "WITH " + ", ".join(ctes) + " " + body


def spark_queries():
    def bind(q):
        return lambda spark, sf_dir: q.plan(Views(spark, sf_dir))
    return {name: bind(q) for name, q in REGISTRY.items()}


def oracles():
    return {name: with_views(q.oracle) for name, q in REGISTRY.items() if q.oracle}
