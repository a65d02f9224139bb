"""Exceptions, by what they tell a caller: content, type, index, size or input/output."""


class SequenceError(ValueError):
    """A sequence, record, alignment or tree breaks a rule."""


class FormatError(SequenceError):
    """A file doesn't follow its format."""
