"""Named queries over the tables of a data folder, each with the SQL that must give the same rows."""

from . import backlog, concepts, corpus, files, ledger, live, records, segments, sessions, states  # noqa: F401  (registration)
from .catalog import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
