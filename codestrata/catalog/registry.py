"""All registered queries: name -> (callable, SQL for the checking engine or None)."""
from importlib import import_module

FAMILIES = ["chunk_queries", "compare_queries", "extract_queries", "graph_queries", "intake_queries", "retrieval_queries", "source_queries", "stream_queries"]


def collect() -> dict:
    found = {}
    for family in FAMILIES:
        found.update(import_module(f"codestrata.catalog.{family}").QUERIES)
    return found
