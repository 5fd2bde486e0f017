"""Errors with a code, and the HTTP status that a surface would answer with."""


class EngineError(Exception):
    code, status = "INTERNAL", 500


class ValidationError(EngineError):
    code, status = "VALIDATION", 400


class NotFoundError(EngineError):
    code, status = "NOT_FOUND", 404


class ConflictError(EngineError):
    code, status = "CONFLICT", 409


class ParseError(EngineError):
    code, status = "PARSE", 422


class ModelError(EngineError):
    """What a model plug-in raises where it can't answer."""

    code, status = "MODEL", 502
