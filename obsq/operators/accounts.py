"""Account lookup and account resolution for tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.functions.accounts import resolved_account
from obsq.schema import ACCOUNT, NOT_FOUND, OK


def lookup_accounts(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Id and name of the account each request row names.

    A row without an account, or with account 0, and a row whose account does
    not exist each keep their place with an error code as ``outcome``.
    """
    named = requests.withColumn("account_id", F.nullif("account_id", F.lit(0)))
    known = accounts.select("account_id", "name", F.lit(True).alias("_known"))
    return (
        named.join(known, "account_id", "left")
        .withColumn(
            "outcome",
            F.when(F.col("account_id").isNull(), ACCOUNT)
            .when(F.col("_known").isNull(), NOT_FOUND)
            .otherwise(OK),
        )
        .drop("_known")
    )


def resolve_accounts(requests: DataFrame, default_account: int | None) -> DataFrame:
    """Fill in the default where a request names no account.

    The explicit account wins, even when it is 0, which is then an error.
    """
    chosen = resolved_account(F.col("account_id"), default_account)
    return requests.withColumn("account_id", chosen).withColumn(
        "outcome", F.when(F.col("account_id").isNull(), ACCOUNT).otherwise(OK)
    )
