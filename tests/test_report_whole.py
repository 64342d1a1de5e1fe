"""A report never leaves out rows without a word."""

import pytest

from tallyrill.plans import report


def test_a_frame_beyond_the_bound_is_refused(spark):
    assert len(report.build_sections(spark.range(1000))[0]["data"]) == 1000
    with pytest.raises(ValueError, match="section_rows"):
        report.build_sections(spark.range(1001))
    with pytest.raises(ValueError, match="section_rows"):
        report.accessibility_sections({}, spark.range(1001))
