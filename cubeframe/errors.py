"""Errors of the container format and of array operations."""


class ArrayError(Exception):
    """Base of all errors raised here."""


class NotFound(ArrayError):
    """No dataset, group or attribute of that name."""


class InvalidState(ArrayError):
    """The operation does not fit the container's or data's state."""


class TypeMismatch(ArrayError):
    """Values do not fit the element type."""


class OutOfBounds(ArrayError):
    """A box of another rank than the array, or beyond its extent."""


class FormatError(ArrayError):
    """Bytes that do not follow the format."""


class InvalidSignature(FormatError):
    pass


class InvalidVersion(FormatError):
    pass


class BufferTooShort(FormatError):
    pass


class ChecksumMismatch(FormatError):
    pass


class UnsupportedFeature(FormatError):
    pass


class InvalidData(FormatError):
    pass
