"""Queries bound to the driver's test tables (see :mod:`.tables`)."""
