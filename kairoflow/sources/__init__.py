"""Readers by name; ``register`` adds more."""

from kairoflow.sources.readers import read_csv, read_frame, read_parquet, read_sql, register, source
from kairoflow.sources.simulate import simulate_events, simulate_intervals, simulate_states, simulate_static, simulate_trajectories
from kairoflow.sources.store import Workspace, load_pool, load_trajectories, save_pool, save_trajectories

__all__ = [
    "read_csv", "read_frame", "read_parquet", "read_sql", "register", "source", "simulate_events", "simulate_intervals", "simulate_states",
    "simulate_static", "simulate_trajectories", "Workspace", "load_pool", "load_trajectories", "save_pool", "save_trajectories",
]
