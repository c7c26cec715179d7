"""Errors that callers may want to tell apart."""


class InfospanError(Exception):
    """Any error of this library."""


class DataShapeError(InfospanError, ValueError):
    """A table lacks a column or has values that an operator can't take."""


class InsufficientDataError(InfospanError):
    """Too few rows for what was asked."""


class TrainingError(InfospanError):
    """A critic's training broke off."""
