"""Churn at many dates and over sliding windows, against one date at a time and a plain count."""

import datetime as dt
import random

import pytest

from forgelens.operators import listing
from forgelens.schemas import COMMITS
from forgelens.streaming.churn import churn_windows, commit_stream, write_churn

DAY = dt.timedelta(days=1)


def _random_commits(seed, n=300):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1, 6)
    rows = []
    for i in range(n):
        # on the edge of a window, a moment beside it, or anywhere
        date = start + rng.randrange(-30, 40) * DAY + rng.choice(
            [dt.timedelta(0), dt.timedelta(microseconds=1), -dt.timedelta(microseconds=1),
             dt.timedelta(seconds=rng.randrange(86400))]
        )
        path = "hot.py" if i % 3 == 0 else f"f{rng.randrange(12)}.py"
        rows.append((rng.choice("ab"), path, f"{i:04d}", date, "m"))
    return rows + [("a", "hot.py", "null", None, "m"), ("a", "f1.py", "old", dt.datetime(1999, 1, 1), "m")]


@pytest.mark.parametrize("seed, step, days, cap", [(1, 1, 7, None), (2, 3, 10, 4), (3, 5, 3, None), (4, 1, 90, 20)])
def test_every_date_is_what_one_date_gives(spark, seed, step, days, cap):
    commits = spark.createDataFrame(_random_commits(seed), COMMITS).repartition(3)
    first = dt.datetime(2024, 1, 1, 6)
    found = listing.churn_history(commits, str(first), 12, step, days, cap)
    got = {(r.repo, r.path, r.as_of): (r.commit_count, r.last_modified) for r in found.collect()}
    expected = {}
    for i in range(12):
        as_of = first + i * step * DAY
        for r in listing.file_churn(commits, str(as_of), days, cap).collect():
            expected[(r.repo, r.path, as_of)] = (r.commit_count, r.last_modified)
    assert got == expected


def test_history_of_nothing(spark):
    commits = spark.createDataFrame(_random_commits(1, 20), COMMITS)
    assert listing.churn_history(commits.limit(0), "2024-01-01", 5).count() == 0
    assert listing.churn_history(commits, "2024-01-01", 0).count() == 0


def _counted(rows, days):
    """Commits per file and window end, one by one."""
    found = {}
    for repo, path, _, date, _ in {r for r in rows if r[3] is not None}:
        end = dt.datetime.combine(date.date(), dt.time()) + DAY
        for k in range(days):
            count, last = found.get((repo, path, end + k * DAY), (0, date))
            found[(repo, path, end + k * DAY)] = (count + 1, max(last, date))
    return found


def _rows(frame):
    return {(r.repo, r.path, r.as_of): (r.commit_count, r.last_modified) for r in frame.collect()}


def test_windows_of_a_table(spark):
    rows = _random_commits(5, 120)
    commits = spark.createDataFrame(rows + rows[:40], COMMITS).repartition(3)
    assert _rows(churn_windows(commits, days=6)) == _counted(rows, 6)
    assert churn_windows(commits.limit(0)).count() == 0
    with pytest.raises(ValueError):
        churn_windows(commits, days=7, slide_days=2)


def test_stream_equals_table_with_late_and_repeated_rows(spark, tmp_path):
    rng = random.Random(6)
    start = dt.datetime(2024, 3, 1)
    at = lambda days: start + dt.timedelta(days=days)
    rows = [("r", f"f{i % 3}", f"{i}", at(i * 0.3 + rng.random() * 0.2), "m") for i in range(60)]
    parts = [rows[i : i + 12] for i in range(0, 60, 12)]
    # moved to a later part, within the lateness allowed; and listed a second time
    late = parts[1].pop(-1)
    parts[2].append(late)
    parts[3] += parts[2][:5] + [late]
    # far too late: its windows are out already
    parts[3].append(("r", "f0", "lost", at(-20), "m"))
    # what lies far ahead lets all windows of the others out
    parts.append([("end", "x", "end", at(400), "m")])
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, part in enumerate(parts):  # one file and one run of the query each
        spark.createDataFrame(part, COMMITS).coalesce(1).write.mode("append").parquet(source)
        query = write_churn(churn_windows(commit_stream(spark, source), 5, lateness="4 days"), out, state)
        query.awaitTermination()
        assert query.exception() is None, i
    streamed = spark.read.parquet(out)
    assert streamed.count() == streamed.select("repo", "path", "as_of").distinct().count()
    table = spark.createDataFrame(rows, COMMITS)
    assert _rows(streamed.where("repo = 'r'")) == _rows(churn_windows(table, 5)) == _counted(rows, 5)
