"""Errors of the engine's operations."""


class FolioError(Exception):
    """Base of the errors below; ``code`` is what an API would send."""

    code = "Internal"


class NotFound(FolioError):
    code = "NotFound"


class Conflict(FolioError):
    code = "Conflict"


class InvalidInput(FolioError):
    code = "InvalidInput"


class Locked(FolioError):
    code = "Locked"


class StorageError(FolioError):
    code = "Storage"
