"""Errors, raised on the driver before a plan is built or when a check finds bad rows."""


class QuantGridError(Exception):
    """Base of all errors of the package."""


class StructureError(QuantGridError):
    pass


class ValidationError(QuantGridError, ValueError):
    pass


class DimensionError(StructureError):
    pass


class MaskCodeError(ValidationError):
    pass


class AssayNotFoundError(QuantGridError, KeyError):
    pass


class LayerNotFoundError(QuantGridError, KeyError):
    pass


class MissingDependencyError(QuantGridError, ImportError):
    pass


class FormatError(QuantGridError):
    """A table can't be read as what it should be."""


class WriteError(QuantGridError):
    pass
