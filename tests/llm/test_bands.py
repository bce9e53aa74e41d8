"""The bands use the whole signature."""

from __future__ import annotations

from lectern.llm import neardup


def test_each_value_is_used_once():
    bands = 2 * neardup.PERMUTATIONS // neardup.BAND
    places = [[neardup.band_value(b, k) for k in range(neardup.BAND)] for b in range(bands)]
    assert sorted(sum(places, [])) == list(range(2 * neardup.PERMUTATIONS))
    assert all(len({x // 2 for x in band}) == neardup.BAND for band in places)
