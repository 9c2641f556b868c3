"""One request, one response: the operations of the library as JSON-like dictionaries."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from skemaforge.sources import star
from skemaforge.sources.catalog import Catalog

from . import analysis, exports, snapshot

OPERATIONS = ("snapshot", "analyze", "resolve", "export", "document", "counts", "graphs")
TARGETS = {"graph": exports.graph_bundle, "vocabulary": exports.vocabulary, "turtle": exports.turtle, "json-ld": exports.json_ld, "interchange": exports.interchange}


def run(request: dict, spark: SparkSession, catalog: Catalog | None = None) -> dict:
    """``operation``, ``path`` of the tables (or a catalog), and for exports ``target``. Errors come back with a code."""
    try:
        op = request.get("operation")
        if op not in OPERATIONS:
            raise ValueError(f"INVALID_ARGUMENT: operation is one of {', '.join(OPERATIONS)}")
        if catalog is None and not request.get("path"):
            raise ValueError("INVALID_ARGUMENT: path is missing")
        catalog = catalog or star.catalog(spark, request["path"])
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  metadata tables only
        if op == "snapshot":
            if not request.get("full"):
                return {"ok": True, "result": rows(catalog.listing())}
            snap = snapshot.snapshot(catalog, int(request.get("samples", 0)))
            return {"ok": True, "result": snap, "fingerprint": snapshot.fingerprint(snap)}
        if op == "counts":
            return {"ok": True, "result": rows(catalog.counts())}
        if op == "graphs":
            return {"ok": True, "result": rows(catalog.graph_table())}
        found = analysis.analyze(catalog, request.get("graph"))
        if op == "analyze":
            return {"ok": True, "result": {"conceptualSchema": found.conceptual, "physicalMapping": found.mapping, "statistics": found.statistics, "shape": found.shape, "metadata": found.extra}}
        if op == "resolve":
            return {"ok": True, "result": found.physical(catalog).resolve()}
        if op == "document":
            return {"ok": True, "result": exports.markdown(found)}
        if request.get("target") not in TARGETS:
            raise ValueError(f"INVALID_ARGUMENT: target is one of {', '.join(TARGETS)}")
        return {"ok": True, "result": TARGETS[request["target"]](found)}
    except ValueError as e:
        code, _, message = str(e).partition(": ")
        known = code == "INVALID_ARGUMENT"
        return {"ok": False, "error": {"code": code if known else "FAILED", "message": message if known else str(e)}}
    except PySparkException as e:
        return {"ok": False, "error": {"code": e.getCondition() or "FAILED", "message": str(e).splitlines()[0]}}
