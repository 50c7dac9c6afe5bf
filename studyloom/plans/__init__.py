"""Registered queries: each binds an operator to tables and names its SQL oracle."""
from importlib import import_module

MODULES = ("analytics", "selection", "memory", "text", "linkage", "corpus", "structure", "sources", "nearcopies", "streams")


def load_all():
    for m in MODULES:
        import_module(f"studyloom.plans.{m}")
