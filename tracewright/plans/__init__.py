"""Registered queries with their SQL, and driver-side orchestration."""
