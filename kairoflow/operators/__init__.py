"""Pools, trajectories and the operators on them."""

from kairoflow.operators.build import Builder, build_events, build_intervals, build_states
from kairoflow.operators.criteria import ANY, WILDCARD, Criterion, Entity, Length, Pattern, Rank, Static, Time
from kairoflow.operators.pool import Pool
from kairoflow.operators.trajectory import Trajectories, build_trajectories

__all__ = [
    "Builder", "build_events", "build_intervals", "build_states", "ANY", "WILDCARD", "Criterion", "Entity", "Length", "Pattern", "Rank",
    "Static", "Time", "Pool", "Trajectories", "build_trajectories",
]
