"""Order-free comparison of a query's rows with those of its SQL."""

import math


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_value(r[k]) for k in order) for r in found)


def same(df, relation):
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows([d[0] for d in relation.description], relation.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in relation.description)
    assert len(ours) == len(theirs)
    assert ours == theirs
