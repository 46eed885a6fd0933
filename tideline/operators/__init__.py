from tideline.operators.evaluation import eval_split, held_out_ssq, kmeans_held_out
from tideline.operators.horizon import horizon_clusters
from tideline.operators.kmeans import (
    assign_clusters,
    cluster_weights,
    decay_centers,
    kmeans_models,
    stream_kmeans,
    stream_kmeans_call,
)
from tideline.operators.linreg import (
    linreg_models,
    linreg_prequential,
    score,
    score_as_of,
    stream_linreg,
    stream_linreg_call,
)
from tideline.operators.microcluster import (
    limit_rows,
    micro_clusters,
    microcluster_models,
    stream_microcluster,
    stream_microcluster_call,
)
from tideline.operators.time_windows import kmeans_time_windows, linreg_time_windows

__all__ = [
    "assign_clusters", "cluster_weights", "decay_centers", "eval_split", "held_out_ssq",
    "horizon_clusters", "kmeans_held_out", "kmeans_models", "kmeans_time_windows", "limit_rows",
    "linreg_models", "linreg_prequential", "linreg_time_windows", "micro_clusters",
    "microcluster_models", "score", "score_as_of", "stream_kmeans", "stream_kmeans_call",
    "stream_linreg", "stream_linreg_call", "stream_microcluster", "stream_microcluster_call",
]
