"""Tables of two rows a partition beyond the bound of a broadcast: joined by shuffle, with the same results."""

import pytest

from bookmerge.llm import _shared
from tests.llm.test_operators import run, world  # noqa: F401


@pytest.mark.parametrize("name", ["op4_chat_windows", "op7_line_dedup", "op9_token_file"])
def test_results_without_a_broadcast(spark, world, monkeypatch, name):  # noqa: F811
    small = run(spark, world, name)
    asked = []
    monkeypatch.setattr(_shared, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(_shared.F, "broadcast", lambda df: asked.append(df) or df)
    large = run(spark, world, name)
    assert small and not asked
    assert sorted(map(repr, large)) == sorted(map(repr, small))
