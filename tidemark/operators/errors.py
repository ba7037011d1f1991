"""Failures of the notice store."""

from __future__ import annotations


class StorageError(Exception):
    """Any failure of the store."""


class StorageInputError(StorageError):
    """A value outside the store's limits."""

    def __init__(self, parameter: str, value: str):
        super().__init__(parameter, value)
        self.parameter, self.value = parameter, value

    def __str__(self) -> str:
        return f"bad value for {self.parameter}: {self.value!r}"


class ReadOnlyStorageError(StorageError):
    """A write through a read-only store."""

    def __init__(self, operation: str):
        super().__init__(operation)
        self.operation = operation

    def __str__(self) -> str:
        return f"this store only reads: {self.operation}"


class SearchUnavailableError(StorageError):
    """Full-text search can't run here: the store has notices, but no index of them."""


class SchemaVersionError(StorageError):
    """The store was written by a newer version."""

    def __init__(self, version: int):
        super().__init__(version)
        self.version = version

    def __str__(self) -> str:
        return f"schema version {self.version} is not known"


class StorageUnavailableError(StorageError):
    """The store can't be opened or read."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason

    def __str__(self) -> str:
        return f"store unavailable: {self.reason}"


class RunBusyError(StorageError):
    """A run that isn't stale holds the lease."""

    def __init__(self, run_id: str):
        super().__init__(run_id)
        self.run_id = run_id

    def __str__(self) -> str:
        return f"run {self.run_id} holds the lease"
