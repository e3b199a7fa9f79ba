"""Errors that callers can tell apart."""


class ValidationError(ValueError):
    """An argument is missing, empty or out of range."""


class NotFoundError(LookupError):
    """A session, event or file that was asked for is not there."""


class UnavailableError(RuntimeError):
    """A search mode was forced that the store cannot serve."""


class DamagedError(RuntimeError):
    """A file does not hold what was written to it; what can be made anew is."""
