"""The queries over the driver's tables; importing this package's ``registry`` users fills it."""

from . import aggregates, joins, projections, registry, signals, streams, tables, windows

__all__ = ["aggregates", "joins", "projections", "registry", "signals", "streams", "tables", "windows"]
