"""Registered queries over the driver tables (see ``registry``)."""
