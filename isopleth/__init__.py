"""isopleth: gridded-field analytics as PySpark DataFrame operators.

Fields are long tables ``(t, iy, ix, <value columns>)`` on a regular
grid; stations are ``(site, t, value, lat, lon)``.  Every operator takes
and returns DataFrames; nothing runs until the caller acts on the result.
"""

from isopleth.grid import Grid

__all__ = ["Grid"]
__version__ = "0.1.0"
