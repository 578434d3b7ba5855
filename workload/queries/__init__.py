"""Importing this package fills the registry."""

from workload.queries import aggregates, joins, panel, pipes, scalars, scans, scm  # noqa: F401
