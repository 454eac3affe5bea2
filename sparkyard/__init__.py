"""sparkyard: a PySpark-native engine for image-dataset analytics and training-data pipelines.

The names below are its public interface; each is loaded when first used.
"""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

_PUBLIC = {
    "get_session": "session", "Scratch": "session", "table": "sources.tables", "VersionedTable": "sources.sinks", "Settings": "operators.validate", "catalog": "operators.catalog", "contract": "operators.contract", "dedup": "operators.dedup",
    "detections": "operators.detections", "evaluate": "operators.evaluate", "files": "sources.files", "fingerprints": "operators.fingerprints", "graph": "operators.graph", "infer": "operators.infer", "labels": "operators.labels", "pairs": "operators.pairs",
    "ranking": "operators.ranking", "rebalance": "operators.rebalance", "series": "streaming.series", "shred": "operators.shred", "sinks": "sources.sinks", "snapshot_diff": "operators.snapshot_diff", "status": "operators.status", "validate": "operators.validate",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(name)
    module = import_module(f"sparkyard.{_PUBLIC[name]}")
    return module if _PUBLIC[name].rsplit(".", 1)[-1] == name else getattr(module, name)
