"""The named queries; importing any module of this package fills the whole catalogue."""

from . import answers, catalog, exchange, outbox, pages, patterns, publication, search, sites, stored, workflow  # noqa: F401
