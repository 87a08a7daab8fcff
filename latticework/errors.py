"""Errors of all operators. Batch operators put ``code`` into an error column instead of raising."""

from __future__ import annotations


class NumericError(Exception):
    code = "Other"

    def __init__(self, message: str = ""):
        super().__init__(f"{self.code}: {message}" if message else self.code)


class EmptyInput(NumericError):
    code = "EmptyInput"


class NotSquare(NumericError):
    code = "NotSquare"


class DimensionMismatch(NumericError):
    code = "DimensionMismatch"


class SingularMatrix(NumericError):
    code = "SingularMatrix"


class NotSymmetric(NumericError):
    code = "NotSymmetric"


class NotPositiveDefinite(NumericError):
    code = "NotPositiveDefinite"


class ConvergenceFailed(NumericError):
    code = "ConvergenceFailed"


class NumericalInstability(NumericError):
    code = "NumericalInstability"


class InvalidInput(NumericError):
    code = "InvalidInput"


class Other(NumericError):
    code = "Other"


KINDS = {k.code: k for k in (EmptyInput, NotSquare, DimensionMismatch, SingularMatrix, NotSymmetric, NotPositiveDefinite, ConvergenceFailed, NumericalInstability, InvalidInput, Other)}


def from_spark(error: Exception) -> Exception:
    """The numeric error that a ``raise_error`` expression stands for, or ``error`` itself."""
    text = str(error)
    return next((kind(text[:200]) for code, kind in KINDS.items() if f"LATTICE:{code}" in text), error)
