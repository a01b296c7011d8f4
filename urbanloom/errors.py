"""Error taxonomy of the engine."""


class ConfigurationError(ValueError):
    """A configuration that cannot be run."""


class GridInputError(ValueError):
    """Grid sources that cannot be standardised."""


class MatrixInputError(ValueError):
    """Travel-time matrices that do not match the locations."""


class ScenarioInputError(ValueError):
    """Policy polygons that cannot be turned into shocks."""


class ShockMapError(ValueError):
    """Shock classes that cannot be mapped."""


class GeoPackageWriteError(OSError):
    """A GeoPackage that could not be published."""


class UnsupportedCrs(ValueError):
    """A coordinate system the engine cannot project."""
