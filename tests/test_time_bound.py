"""A bound on the time of the other side of a join."""

import re

from sitewise.queries import load


def test_matches_in_time_are_counted_without_grouping_the_times(spark, folder, capsys):
    capsys.readouterr()
    load().QUERIES["join_time_bound"](spark, folder).explain()
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", capsys.readouterr().out)
    assert keys and not any("transfertime" in k for k in keys)
