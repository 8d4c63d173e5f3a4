"""Small conveniences for building tables and reading results and plans."""

from obsq.schema import TABLES, ENTITY, SEARCH_REQUEST


def table(spark, name, *rows):
    """A logical table from dicts; missing columns are null."""
    schema = {"search_request": SEARCH_REQUEST}.get(name) or TABLES[name]
    return spark.createDataFrame([[r.get(f.name) for f in schema] for r in rows], schema)


def entities(spark, *rows):
    full = []
    for row in rows:
        row = {"domain": "APM", "type": "APPLICATION", "account_id": 1, "tags": [], **row}
        row.setdefault("entity_type", f"{row['domain']}_{row['type']}")
        full.append([row.get(f.name) for f in ENTITY])
    return spark.createDataFrame(full, ENTITY)


def values(df, *columns):
    """Rows as sorted tuples, or plain values for one column."""
    picked = df.select(*columns) if columns else df
    rows = [tuple(r) for r in picked.collect()]
    if len(columns) == 1:
        rows = [r[0] for r in rows]
    return sorted(rows, key=lambda r: str(r))


def outcomes(df, column="outcome"):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def plan(df):
    """The physical plan as Spark ran it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def first_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows that the scans of a plan without shuffles gave, after skipping row groups."""
    executed = df._jdf.queryExecution()
    plan = executed.executedPlan()
    executed.toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
