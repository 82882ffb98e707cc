"""Composite stages: planner, quality, schedules, surveys, metrics, and the registered queries."""
