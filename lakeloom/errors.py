"""Exceptions of the table layer, grouped by what went wrong."""

from __future__ import annotations


class LakeloomError(Exception):
    """Base of all errors raised by this package."""


class CatalogError(LakeloomError):
    """A catalog lookup or change failed."""


class NamespaceNotFound(CatalogError):
    pass


class NamespaceAlreadyExists(CatalogError):
    pass


class NamespaceNotEmpty(CatalogError):
    pass


class TableNotFound(CatalogError):
    pass


class TableAlreadyExists(CatalogError):
    pass


class TransactionError(LakeloomError):
    """A commit failed."""


class CommitConflict(TransactionError):
    """Another commit changed what this one depends on."""


class MaxRetriesExceeded(TransactionError):
    """Every attempt lost the race for the next version."""


class NoChanges(TransactionError):
    """The transaction has nothing to commit."""


class ReadOnlyTable(TransactionError):
    """A time-travel view cannot be written to."""


class ValidationError(LakeloomError):
    """Rows or schemas break the table's rules."""


class SchemaMismatch(ValidationError):
    pass


class NullInRequiredColumn(ValidationError):
    pass


class IncompatibleSchema(ValidationError):
    pass


class MergeCardinalityError(ValidationError):
    """More than one source row would change the same target row."""


class MetadataError(LakeloomError):
    """Table metadata lacks something that was asked for."""


class SchemaNotFound(MetadataError):
    pass


class SnapshotNotFound(MetadataError):
    pass
