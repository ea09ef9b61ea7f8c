"""The operators on Structured Streaming sources."""

from tripleflow.streaming.delta import DeltaQuery, delta_schema, stream_bgp_delta
from tripleflow.streaming.fold import AVAILABLE_NOW, State, fold_batches, read_output, run_to_end
from tripleflow.streaming.standing import stream_match_table, stream_queries
from tripleflow.streaming.stateful import (
    stream_bounded_join,
    stream_pair_up,
    stream_pair_up_obj_subj,
    stream_threshold,
)
from tripleflow.streaming.stateless import (
    read_count_table,
    stream_bgp,
    stream_collect,
    stream_count_table,
    stream_counts,
    stream_match,
    stream_match_each,
    stream_row_counts,
)
from tripleflow.streaming.windows import stream_window_counts

__all__ = [
    "AVAILABLE_NOW",
    "DeltaQuery",
    "State",
    "delta_schema",
    "fold_batches",
    "read_count_table",
    "read_output",
    "run_to_end",
    "stream_bgp",
    "stream_bgp_delta",
    "stream_bounded_join",
    "stream_collect",
    "stream_count_table",
    "stream_counts",
    "stream_match",
    "stream_match_each",
    "stream_match_table",
    "stream_pair_up",
    "stream_pair_up_obj_subj",
    "stream_queries",
    "stream_row_counts",
    "stream_threshold",
    "stream_window_counts",
]
