"""Registered queries."""

from importlib import import_module

FAMILIES = ["source", "projection", "fact", "diagram", "change", "impact", "report", "ingest", "stream"]


def load() -> None:
    """Import every family, which registers its queries."""
    for family in FAMILIES:
        import_module(f"driftmap.plans.{family}_queries")
