"""Errors of the library."""


class NotFittedError(RuntimeError):
    """The operation needs a fitted model."""


class FittedError(RuntimeError):
    """The operation is not open to a fitted model."""


class ValidationError(ValueError):
    """The history breaks a rule."""
