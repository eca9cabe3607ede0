"""Registered queries and the SQL that checks them. The registry comes first, whichever module is asked for."""

from quire.plans import registry  # noqa: F401
