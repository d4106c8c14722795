"""Registered queries over the operators. Importing this package fills the registry."""

from . import aggregates, change, domain, joins, live, loads, models, relational, scalars, warehouse  # noqa: F401
