import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scenaria.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("scenaria-tests", cores=8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    def make(schema, *rows):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make


def rows_of(df, *cols):
    """Sorted tuples, NULLs last."""
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def final_plan(df):
    """Text of the executed adaptive plan, subqueries included, without the
    initial plans that Spark prints beside the final ones."""
    lines, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth >= skip:
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = line.index("== Initial")
            continue
        lines.append(line)
    return "\n".join(lines)
