"""Errors by the status a service would give them."""


class EngineError(Exception):
    """Anything this engine refuses or fails at."""

    status = 500


class QueryError(EngineError):
    """A query that cannot be parsed, bound or run."""

    status = 400


class UnsupportedError(QueryError):
    """An operator that the fields asked for do not have."""


class ValidationError(EngineError):
    """A request outside its limits."""

    status = 422


class NotFoundError(EngineError):
    """A resource, configuration or job that does not exist."""

    status = 404
