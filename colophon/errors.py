"""Errors of the driver; errors of single rows are columns, not exceptions."""


class ColophonError(Exception):
    """Base of all errors that a run reports instead of crashing on."""


class ConfigError(ColophonError):
    pass


class MissingInput(ColophonError):
    pass


class FormatError(ColophonError):
    pass


class BatchError(ColophonError):
    pass


class StepError(ColophonError):
    pass


class TransientError(ColophonError):
    """A call that may succeed when tried again."""


class PermanentError(ColophonError):
    """A call that won't succeed however often it is tried."""
