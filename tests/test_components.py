import pytest

from fescue.operators.fixef import _components


def test_chain_of_levels_is_one_component_or_an_error(spark):
    """a1 and a2 share b1, a2 and a3 share b2, and so on; a second chain stands apart."""
    rows = [(f"{c}{k + d:03d}", f"{c}b{k}") for c in "xy" for k in range(40) for d in (0, 1)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {r.a: r.label for r in _components(df, "a", "b").collect()}
    assert got == {f"{c}{k:03d}": f"{c}000" for c in "xy" for k in range(41)}
    with pytest.raises(RuntimeError):
        _components(df, "a", "b", most=2)
