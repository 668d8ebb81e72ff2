"""What a query does not need is left out before it is exchanged, grouped or written."""

from sitewise.queries import load
from sitewise.queries.frames import Frames
from sitewise.queries.series import timestamp_finished, timestamp_matrix
from sitewise.queries.stays import timestamp_cohort, timestamp_static
from sitewise.plans import matrices

load()


def ordered(df):
    return sorted(map(repr, df.collect()))


def test_stays_kept_are_those_of_the_whole_cohort(spark, folder):
    fr = Frames(spark, folder)
    whole = timestamp_cohort(fr)
    stays, static = timestamp_finished(fr)
    assert stays.filter("excluded <> 0 or excluded is null").isEmpty()
    assert 0 < stays.count() < whole.count()
    assert ordered(stays) == ordered(whole.filter("excluded = 0"))
    kept = stays.select("icustay_id")
    assert ordered(static) == ordered(timestamp_static(fr, whole).join(kept, "icustay_id", "left_semi"))


def test_event_tables_are_read_from_rows_of_the_visits_kept(spark, folder):
    fr = Frames(spark, folder)
    stays, static = timestamp_finished(fr)
    timed = fr.timed
    timestamp_matrix(fr, stays, static, matrices.day_one_windows(stays, static, "icustay_id"), 24)
    assert ordered(fr.timed) == ordered(timed.join(stays.select("hadm_id"), "hadm_id", "left_semi").select(*fr.timed.columns))
    assert all(set(map(str, t.inputFiles())) == set(fr.timed.inputFiles()) for t in (fr.s_vital, fr.s_gcs, fr.s_uo, fr.s_bg, fr.s_lab))
