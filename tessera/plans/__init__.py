"""Migrations: a graph of steps, its levels, and a runner with retries and replays."""
