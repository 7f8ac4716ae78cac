"""Errors of the library, one class for each kind of failure."""


class WeftlineError(Exception):
    """Base of all errors raised on purpose."""


class FitFailed(WeftlineError):
    """Training could not produce a model."""


class PredictFailed(WeftlineError):
    """A fitted model could not be applied."""


class TransformFailed(WeftlineError):
    """A transformation met data it was not fitted for."""


class FindFailed(WeftlineError):
    """A neighbour search was asked something impossible."""


class DecompositionFailed(WeftlineError):
    """A matrix has no such factorisation."""


class SolutionFailed(WeftlineError):
    """A linear system has no solution."""


class ParametersError(WeftlineError, ValueError):
    """A parameter is out of range or inputs do not fit together."""


class ReadingError(WeftlineError):
    """A source could not be read; ``kind`` names why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind

    @property
    def message(self) -> str:
        return str(self)
