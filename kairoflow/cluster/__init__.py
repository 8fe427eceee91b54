"""Clustering of sequences: k-medoids, sampled k-medoids, agglomerative."""

from kairoflow.cluster.medoids import CLARA, PAM, Hierarchical, agglomerate, pam

__all__ = ["CLARA", "PAM", "Hierarchical", "agglomerate", "pam"]
