"""All queries; the modules named here add theirs when they are read."""

from __future__ import annotations

from fieldmosaic.plans import catalog, estimation, models, population, prediction, space, stored

MODULES = (catalog, population, estimation, prediction, space, models, stored)
QUERIES, SQL = catalog.QUERIES, catalog.SQL
