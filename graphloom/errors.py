"""Errors a caller can act on, and the status code each maps to at a service edge."""


class EngineError(Exception):
    status = 500


class NotFound(EngineError):
    status = 404


class Invalid(EngineError):
    """A request that breaks a rule of ours, such as a limit above its ceiling."""

    status = 400


class Malformed(Invalid):
    """A value that no request may hold, such as a limit below one or an empty name."""

    status = 422


class InvalidSource(Invalid):
    pass


class UnsafeArchive(InvalidSource):
    pass


class WorkspaceProblem(EngineError):
    status = 500


class ImportFailed(EngineError):
    status = 422


class ParseFailed(EngineError):
    pass


class WrongState(EngineError):
    status = 409


class Conflict(WrongState):
    """Another writer was faster."""


class QueryTimeout(EngineError):
    status = 503
