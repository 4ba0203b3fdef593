"""Errors of this package."""


class QuireError(Exception):
    """Any error of this package."""


class UnsupportedFormat(QuireError):
    """A file's format can't be told, or has no parser."""


class ExtractionFailed(QuireError):
    """A file couldn't be parsed and the policy is to raise."""


class BadSettings(QuireError, ValueError):
    """A setting has a value that it can't have."""
