"""Registered queries: thin wrappers that apply the operators to the driver's tables."""

# Executors import a query module by its own name: the registry comes first, so that all load in its order.
import docengine.registry  # noqa: F401
