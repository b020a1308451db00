"""What a plan shuffles."""

import re
from contextlib import contextmanager


@contextmanager
def settings(spark, **values):
    names = {k: k.replace("__", ".") for k in values}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_broadcast(spark):
    return settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


def shuffled_columns(df):
    """Column names of the input of every shuffle in the plan."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"^\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", text, re.M)
    return [{name.split("#")[0] for name in inputs.split(", ") if name} for inputs in found]


def scans_below_shuffles(df, table):
    """Scans of a staged table that a shuffle stands right above, with no join or aggregation between."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:+\-*()\d]*", line).group()) for line in lines]
    found = []
    for at, line in enumerate(lines):
        if table not in line or "Scan" not in line:
            continue
        level = depth[at]
        for above in range(at - 1, -1, -1):
            if depth[above] < level:
                level = depth[above]
                if re.search("Join|Aggregate", lines[above]):
                    break
                if re.search(r"\bExchange", lines[above]):
                    found.append(lines[above].strip())
    return found
