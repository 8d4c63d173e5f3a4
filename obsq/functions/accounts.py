"""Account rules: explicit, else default, and 0 never counts as one."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.errors import AccountRequired


class _AllAccounts:
    def __repr__(self) -> str:
        return "ALL_ACCOUNTS"


ALL_ACCOUNTS = _AllAccounts()
"""Ask for every account explicitly; leaving the account out means the default."""


def resolve_account(account: int | None, default: int | None) -> int:
    """The account of a single call, or an error."""
    chosen = account if account is not None else default
    if not chosen:
        raise AccountRequired("an account is required: none was given and no default is set")
    return chosen


def resolved_account(account: Column, default: int | None) -> Column:
    """The account of each request row, null where there is none to use."""
    chosen = F.coalesce(account, F.lit(default).cast("int"))
    return F.nullif(chosen, F.lit(0))


def in_accounts(
    rows: DataFrame,
    accounts: int | Collection[int] | DataFrame | _AllAccounts | None,
    default: int | None = None,
) -> DataFrame:
    """Rows of the accounts asked for.

    ``accounts`` is one account, a list of them, a DataFrame with an
    ``account_id`` column, ``ALL_ACCOUNTS``, or None for the default account.
    """
    if accounts is ALL_ACCOUNTS:
        return rows
    if isinstance(accounts, DataFrame):
        wanted = accounts.select("account_id").filter("account_id <> 0")
        return rows.join(wanted, "account_id", "left_semi")
    if accounts is None or isinstance(accounts, int):
        return rows.filter(F.col("account_id") == resolve_account(accounts, default))
    ids = [resolve_account(a, None) for a in accounts]
    if not ids:
        raise AccountRequired("the list of accounts is empty")
    return rows.filter(F.col("account_id").isin(ids))
