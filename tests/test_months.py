"""Month ranges in a zone: fixed cases, one of them with a change of clocks."""

from __future__ import annotations

from datetime import datetime

from tidemark.operators import calendar


def test_ranges_by_the_clock_of_a_zone(spark):
    got = [tuple(r) for r in calendar.month_ranges(spark, "2024-11", "2025-04", "America/Santiago").orderBy("start").collect()]
    assert got == [
        (2024, 11, datetime(2024, 11, 1), datetime(2024, 11, 30, 23, 59, 59), 1730430000000, 1733021999000), (2024, 12, datetime(2024, 12, 1), datetime(2024, 12, 31, 23, 59, 59), 1733022000000, 1735700399000),
        (2025, 1, datetime(2025, 1, 1), datetime(2025, 1, 31, 23, 59, 59), 1735700400000, 1738378799000), (2025, 2, datetime(2025, 2, 1), datetime(2025, 2, 28, 23, 59, 59), 1738378800000, 1740797999000),
        (2025, 3, datetime(2025, 3, 1), datetime(2025, 3, 31, 23, 59, 59), 1740798000000, 1743476399000), (2025, 4, datetime(2025, 4, 1), datetime(2025, 4, 30, 23, 59, 59), 1743476400000, 1746071999000),
    ]


def test_spans_end_with_the_last_day(spark):
    got = [tuple(r) for r in calendar.month_spans(spark, "2024-11-15", "2025-02-10").orderBy("start").collect()]
    assert got == [(datetime(2024, 11, 1), datetime(2024, 11, 30, 23, 59, 59, 999000)), (datetime(2024, 12, 1), datetime(2024, 12, 31, 23, 59, 59, 999000)), (datetime(2025, 1, 1), datetime(2025, 1, 31, 23, 59, 59, 999000)), (datetime(2025, 2, 1), datetime(2025, 2, 10))]
