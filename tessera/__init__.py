"""A PySpark-native analytics engine for metadata of text-bearing records."""

#: Public names and where they live; loaded when first asked for, so that a worker which needs one module does not load all.
EXPORTS = {
    "Policy": "plans.policy", "Axis": "plans.policy", "default_policy": "plans.policy", "run_pipeline": "plans.run", "Run": "plans.run", "payload": "plans.run",
    "classify": "plans.classify", "normalize": "plans.normalize", "resolve": "plans.embedding", "Backend": "plans.embedding", "cascade": "operators.grouping", "numbered": "operators.grouping",
    "members": "operators.grouping", "components": "operators.components", "jaccard_pairs": "operators.pairs", "hamming_pairs": "operators.pairs", "cosine_pairs": "operators.pairs",
    "rename_collisions": "operators.ranking", "files": "sources.scan", "images": "sources.scan", "write_tree": "sources.demo",
}
__all__ = sorted(EXPORTS)


def __getattr__(name: str):
    import importlib

    if name not in EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"tessera.{EXPORTS[name]}"), name)
