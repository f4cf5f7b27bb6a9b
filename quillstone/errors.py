"""Errors of the library."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all; recoverable: trying again can help; corruption: data on disk are damaged."""

    recoverable = False
    corruption = False


class DocumentNotFound(StoreError, KeyError):
    pass


class CollectionNotFound(StoreError, FileNotFoundError):
    pass


class InvalidDocumentId(StoreError, ValueError):
    pass


class InvalidDocument(StoreError, ValueError):
    pass


class SchemaMismatch(StoreError, ValueError):
    pass


class ReadOnlyStore(StoreError, PermissionError):
    pass


class StoreLocked(StoreError):
    recoverable = True


class InvalidContainer(StoreError, ValueError):
    pass


class DamagedMetadata(StoreError):
    corruption = True
