"""Reusable DataFrame operators: norms, ranks, nearest and containment joins, rollups."""
