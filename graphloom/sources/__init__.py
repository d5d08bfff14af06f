from .registry import SourceError, Sources  # noqa: F401
