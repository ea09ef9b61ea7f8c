"""Pattern matching and correlation over subject-predicate-object triples on Spark.

Every operator takes and returns DataFrames, so they chain with ``df.transform``
and are planned, shuffled and run by Spark.
"""

from tripleflow.operators.aggregate import (
    anova_oneway,
    first_and_last,
    means_by,
    numeric_mean,
    rollup_partials,
    sort_by_leading_number,
)
from tripleflow.operators.correlate import (
    bounded_join,
    bounded_multi_join,
    pair_up,
    pair_up_obj_subj,
    threshold_reached,
)
from tripleflow.operators.counts import (
    collect_timed,
    count_each,
    count_matches,
    count_packed,
    count_patterns,
    publish,
    render,
)
from tripleflow.operators.hypercube import one_shuffle_join
from tripleflow.operators.joins import cross, multi_join, natural_join
from tripleflow.operators.match import (
    match,
    match_each,
    match_packed,
    match_shared,
    match_streams,
    share_scan,
)
from tripleflow.patterns import DEFAULT_QUERY, pattern, patterns
from tripleflow.plans.bgp import bgp, bgp_grouped, count_bgp
from tripleflow.plans.reduce import bgp_reduced, reduce_relations
from tripleflow.plans.domain import domain_cardinality
from tripleflow.operators.pattern_table import match_table, patterns_at
from tripleflow.sources.lines import clean_lines, enqueue_lines, queue_lines, read_lines
from tripleflow.sources.triples import (
    kv_triples,
    parse_kv,
    parse_triples,
    parse_words,
    parse_words_int,
    to_lines,
    triple_universe,
    validate_triples,
)

__all__ = [
    "DEFAULT_QUERY",
    "anova_oneway",
    "bgp",
    "bgp_grouped",
    "bgp_reduced",
    "bounded_join",
    "bounded_multi_join",
    "clean_lines",
    "collect_timed",
    "count_bgp",
    "count_each",
    "count_matches",
    "count_packed",
    "count_patterns",
    "cross",
    "domain_cardinality",
    "enqueue_lines",
    "first_and_last",
    "kv_triples",
    "match",
    "match_each",
    "match_packed",
    "match_shared",
    "match_streams",
    "match_table",
    "means_by",
    "multi_join",
    "natural_join",
    "numeric_mean",
    "one_shuffle_join",
    "pair_up",
    "pair_up_obj_subj",
    "parse_kv",
    "parse_triples",
    "parse_words",
    "parse_words_int",
    "pattern",
    "patterns",
    "patterns_at",
    "publish",
    "queue_lines",
    "read_lines",
    "reduce_relations",
    "render",
    "rollup_partials",
    "share_scan",
    "sort_by_leading_number",
    "threshold_reached",
    "to_lines",
    "triple_universe",
    "validate_triples",
]
