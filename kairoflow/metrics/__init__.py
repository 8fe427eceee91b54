"""Distances between rows, sequences and trajectories."""

from kairoflow.metrics.entity import Combined, EntityMetric, Hamming, SquaredL2
from kairoflow.metrics.matrix import DistanceMatrix, resumable
from kairoflow.metrics.sequence import METRICS, DTW, LCP, LCS, Chi2, Edit, LinearPairwise, SequenceMetric, SoftDTW, metric
from kairoflow.metrics.trajectory import Aggregation, StaticMetric

__all__ = [
    "Combined", "EntityMetric", "Hamming", "SquaredL2", "DistanceMatrix", "resumable", "METRICS", "DTW", "LCP", "LCS", "Chi2", "Edit",
    "LinearPairwise", "SequenceMetric", "SoftDTW", "metric", "Aggregation", "StaticMetric",
]
