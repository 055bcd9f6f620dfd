import pytest

from windowflow import catalog
from windowflow.functions.aggregates import Agg
from windowflow.functions.expressions import Const, Ref
from windowflow.operators.core import Aggregate, Custom, NoOp, Project, Select, StaticJoin
from windowflow.operators.window import WindowSpec
from windowflow.plans.query import Application, Query


def test_printed_forms():
    for x, said in catalog._PRINTED.values():
        assert x.describe() == said
    assert (Ref("fare") / Ref("distance") - Const(2.5, "float")).describe() == "((fare / distance) - 2.5:float)"
    assert Aggregate(WindowSpec.session(30), [Agg("max", "fare", "top")]).describe() == "aggregate max(fare) as top over session 30"
    assert StaticJoin(None, "zone", "id", ("name",)).describe() == "join table on zone = id"
    pipeline = Query(4, [NoOp(), Select(Ref("fare") > 3), Project([("f", Ref("fare") + 1)]), Custom(lambda df: df, "as it is")])
    assert pipeline.describe() == ["pass", "select fare > 3", "project (fare + 1) as f", "as it is"]


@pytest.mark.parametrize(("size", "slide", "want"), [(45, 30, (15, 3, 2)), (7, 7, (7, 1, 1)), (100, 1, (1, 100, 1)), (90, 40, (10, 9, 4))])
def test_panes(size, slide, want):
    w = WindowSpec.rows(size, slide)
    assert (w.pane, w.panes, w.panes_per_slide) == want


@pytest.mark.parametrize("make", [
    lambda: WindowSpec.range(9, 12), lambda: WindowSpec.rows(0), lambda: WindowSpec.rows(3, -1), lambda: WindowSpec.session(-2), lambda: WindowSpec("days", 1, 1),
    lambda: Agg("mode", "fare"), lambda: Agg("w_avg", "fare"), lambda: Aggregate(WindowSpec.range(3), []),
    lambda: Aggregate(WindowSpec.range(3), [Agg("sum", "fare", "x"), Agg("min", "fare", "x")]), lambda: Aggregate(WindowSpec.range(3), [Agg("cnt")], [("k", "k")], fill=True),
])
def test_mistakes_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_graphs_run_in_order_and_circles_are_refused():
    a, b, c = (Query(i, [Select(Ref("fare") < i)]) for i in range(3))
    b.connect_to(c)
    a.connect_to(b)
    app = Application([c, b, a])
    assert ([q.ident for q in app.sources()], [q.ident for q in app.sinks()]) == ([0], [2])
    x, y = Query(1, [NoOp()]), Query(2, [NoOp()])
    x.connect_to(y)
    y.connect_to(x)
    with pytest.raises(ValueError):
        Application([x, y]).run({})
