from .responses import reason_counts, validate_stream  # noqa: F401
