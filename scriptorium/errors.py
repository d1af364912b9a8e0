"""Errors of the engine, one kind for each part that can fail."""


class EngineError(Exception):
    """Base of all errors raised here."""


class DocumentLoadError(EngineError):
    """A page source can't be read or decoded."""


class ImageIngestionError(EngineError):
    """An image has no readable text or an unknown type."""


class EmbeddingError(EngineError):
    """An embedder failed."""


class VectorStoreError(EngineError):
    """A stored collection can't be read or written."""


class RetrievalError(EngineError):
    """A search was asked for nothing, or of an empty store."""


class GenerationError(EngineError):
    """A text generator failed."""


class RoutingError(EngineError):
    """No tool fits a question."""


class EvaluationError(EngineError):
    """Nothing could be evaluated."""
