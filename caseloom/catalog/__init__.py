"""All registered queries; importing this package fills the registry."""

from caseloom.catalog import aggregates, exchange, filtering, likelihood, ordering, prediction, streams, structure  # noqa: F401
from caseloom.catalog.base import COVERS, QUERIES, SQL  # noqa: F401
