import pytest

from tripleflow.patterns import (
    DEFAULT_QUERY,
    canonical,
    connected_order,
    group_by_shared_vars,
    part_products,
    pattern,
    patterns,
    variables,
)


def test_pattern_needs_three_parts():
    assert pattern("?a_foo_?b") == ("?a", "foo", "?b")
    assert pattern(("x_y", "?p", "z")) == ("x_y", "?p", "z")
    for bad in ("a_b", "a_b_c_d", ("a", "b")):
        with pytest.raises(ValueError):
            pattern(bad)


def test_empty_query_is_refused():
    for empty in ("", [], "^"):
        with pytest.raises(ValueError):
            patterns(empty)


def test_query_text_and_list_are_equal():
    assert patterns("^".join(DEFAULT_QUERY)) == patterns(DEFAULT_QUERY)


def test_canonical_ignores_names_but_not_repetition():
    assert canonical(pattern("?a_foo_?b")) == canonical(pattern("?x_foo_?y"))
    assert canonical(pattern("?a_foo_?a")) != canonical(pattern("?a_foo_?b"))
    assert canonical(pattern("?a_foo_?a")) == canonical(pattern("?z_foo_?z"))


def test_groups_of_default_query():
    assert group_by_shared_vars(patterns(DEFAULT_QUERY)) == [[0, 1, 2, 3], [4, 5, 6]]


def test_group_members_share_the_same_variables_pairwise():
    # the third shares ?a with the first but ?b with the second
    assert group_by_shared_vars(patterns(["?a_p_?b", "?b_q_?c", "?a_r_?c"])) == [[0, 1], [2]]


def test_group_that_another_group_restricts_is_cut():
    # customers and suppliers of a nation would meet all with all; orders tell which belong together
    cycle = patterns(["?n_inRegion_R1", "?c_inNation_?n", "?o_placedBy_?c", "?o_soldBy_?s", "?s_inNation_?n"])
    groups = group_by_shared_vars(cycle)
    assert groups == [[0, 1, 4], [2, 3]]
    assert part_products(cycle, groups) == [[0, 1], [2, 3], [4]]
    default = patterns(DEFAULT_QUERY)
    assert part_products(default, group_by_shared_vars(default)) == [[0, 1, 2, 3], [4, 5, 6]]


def test_connected_order_waits_for_a_shared_variable():
    sets = [variables(p) for p in patterns(["?a_p_1", "?b_p_2", "?a_q_?b", "?z_p_3"])]
    assert connected_order(sets) == [[0, 2, 1], [3]]
