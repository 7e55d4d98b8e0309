"""Import every catalog module so that its queries are registered."""

from prefloom.catalog import discovery, feedback, modelling, operations, policy, ranking, streams, tables  # noqa: F401
