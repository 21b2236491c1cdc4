"""No table of a row an item or more goes through the driver."""

import contextlib
import io

from tagloom import registry

SF = "/root/testdata/sf0.001"


def test_prompts_broadcast_nothing(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries()["graph_prompts"](spark, SF).explain()
    assert "SortMergeJoin" in out.getvalue() and "Broadcast" not in out.getvalue()
