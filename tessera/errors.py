"""Error tree, raised on the driver before any job is started where possible."""


class DatasetError(Exception):
    """Base class of every error raised by tessera."""


class ConfigError(DatasetError):
    """A recipe or an option is invalid."""


class LoaderError(DatasetError):
    """A source cannot be read."""


class UnsupportedFormatError(LoaderError):
    """No reader is registered for a file extension."""


class SourceNotFoundError(LoaderError):
    """A source path does not exist."""


class ValidationError(DatasetError):
    """Data does not satisfy a required property (missing field, bad index)."""


class SamplingError(DatasetError):
    """Unknown sampling strategy or bad offset / limit."""
