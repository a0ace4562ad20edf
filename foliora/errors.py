"""Errors of the engine."""


class FolioraError(Exception):
    """Base of all errors of the engine."""


class ConfigurationError(FolioraError):
    """A parameter or setting is not valid."""


class DocumentError(FolioraError):
    """A document can't be read."""


class ModelError(FolioraError):
    """A provider failed."""


class VectorStoreError(FolioraError):
    """The vector index can't do what is asked."""


class KeywordStoreError(FolioraError):
    """The keyword index can't do what is asked."""


class IndexConsistencyError(FolioraError):
    """The two indexes of a collection differ."""


class RegistryError(FolioraError):
    """A file, collection or registry entry is not in the needed state."""


class JobError(FolioraError):
    """A job can't be made or found."""


class OutputFormatError(FolioraError):
    """A result can't be formatted as asked."""
