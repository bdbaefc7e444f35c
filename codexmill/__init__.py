"""codexmill: a Spark-native engine that turns source files and documents into a searchable knowledge base."""

from importlib import import_module

#: Public names and where they live; loaded on first use, so that workers import only what they run.
_PLACES = {
    "ChunkConfig": "config", "GenerationConfig": "config", "custom": "config", "for_project_type": "config", "preset": "config",
    "Engine": "plans.index", "IndexResult": "plans.index", "QueryResult": "plans.index", "report": "plans.index",
    "StageError": "errors", "HashEmbedder": "services", "ExtractiveGenerator": "services",
}

__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(f"codexmill.{_PLACES[name]}"), name)
    raise AttributeError(name)
