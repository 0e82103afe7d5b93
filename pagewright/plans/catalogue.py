"""All queries of the core, by name."""

from __future__ import annotations

from pagewright.plans import exporting, inspecting, laying_out, measuring, nested, others, reading

MODULES = [nested, reading, inspecting, laying_out, exporting, measuring, others]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
