"""Errors raised for a single bad argument, before any plan is built.

Operators that take a table of requests never raise for one bad row; they put
the matching code from :mod:`obsq.schema` into an ``outcome`` column instead.
"""


class RequestError(ValueError):
    """An argument that no data could make valid."""


class AccountRequired(RequestError):
    """No usable account: none given and no default, or account 0."""
