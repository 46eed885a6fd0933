from tideline.feeds.keyed import run_keyed_stream
from tideline.feeds.runner import (
    KMeansStream,
    LinRegStream,
    MicroClusterStream,
    late_rows,
    run_stream,
)
from tideline.feeds.time_feed import run_time_clusters, run_time_windows

__all__ = [
    "KMeansStream", "LinRegStream", "MicroClusterStream", "late_rows", "run_keyed_stream",
    "run_stream", "run_time_clusters", "run_time_windows",
]
