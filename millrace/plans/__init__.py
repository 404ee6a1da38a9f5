"""Query plans over the test tables; importing the modules fills the catalogue."""

from . import compare, explore, joins, metrics, records, runs, selection, significance, tasks  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
