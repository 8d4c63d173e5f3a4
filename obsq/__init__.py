"""Observability analytics on Spark: entities, events, incidents, monitors."""

from obsq.errors import AccountRequired, RequestError
from obsq.functions.accounts import ALL_ACCOUNTS
from obsq.workspace import Workspace

__all__ = ["ALL_ACCOUNTS", "AccountRequired", "RequestError", "Workspace"]
